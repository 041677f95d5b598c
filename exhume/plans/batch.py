"""From a batch CSV to scores, rejected runs and a report in one call, for every suite.

A row of the CSV is a run, known by its place ``run_pos`` from reading to report, so runs of one case and tool never mix. A run that
cannot be scored is in ``rejected`` with a reason; every run is in exactly one of the two tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exhume.functions.text import case_key
from exhume.operators.fingerprint import fingerprint64, image_lowfreq
from exhume.operators.validate import dfr_reasons, gt_presence
from exhume.plans import carving, dfr, registry, sqlite, string_search, suite
from exhume.session import Scratch
from exhume.sinks.results import SUMMARY_COUNTS, append_results, replace_parts
from exhume.sources.inputs import read_images, read_registry_csv, read_submission_batch

SCORES = ["tp", "fp", "fn", "precision", "recall", "f1"]
RUN = ["base_test_case", "tool_used"]


@dataclass
class Batch:
    """``results``: test_suite, run_pos, base_test_case, tool_used and scores; ``rejected``: run_pos, base_test_case, tool_used, reason.

    ``summary``: test_suite, run_pos, base_test_case, test_case (case and tool), score and the counts of the summary that the suite has.
    """

    results: DataFrame
    rejected: DataFrame
    summary: DataFrame

    def report(self) -> DataFrame:
        """The result rows and the suite's mean."""
        return suite.suite_report(self.results.withColumnRenamed("run_pos", "row_pos"))

    def write(self, folder: str, task: str, job_id: str) -> None:
        """K1: results and rejected runs of a job; written again, they replace what the job wrote before."""
        append_results(self.results, f"{folder}/results", task, job_id)
        replace_parts(self.rejected.withColumns({"task": F.lit(task), "job": F.lit(f"j{job_id}")}), ["task", "job"], "json", f"{folder}/rejected")


def place(path: Column) -> Column:
    """A path as text without scheme and escapes, so that listed and submitted ones compare."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.when(path.startswith("file:"), F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))).otherwise(plain)


def _string_search(spark: SparkSession, runs: DataFrame, gt: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    lines = runs.select("base_test_case", "os", F.col("run").alias("tool_used"), F.explode_outer("payload").alias("line"))
    absent = gt_presence(runs, gt, {"base_test_case": "base_test_case", "os": "os"}).select("run", "reason")
    return string_search.string_search_score(lines, gt).withColumnRenamed("tool_used", "run"), absent


def _deleted_files(spark: SparkSession, runs: DataFrame, gt: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    named = runs.select("base_test_case", F.col("run").alias("tool_used"), "test_set", "file_system", "check_meta", "payload")
    files = named.select(*[c for c in named.columns if c != "payload"], F.posexplode("payload").alias("sub_pos", "_f"))
    files = files.select("*", "_f.*").drop("_f").withColumn("sub_pos", F.col("sub_pos").cast("bigint"))
    judged = dfr_reasons(named.drop("payload", "file_system"), files.drop("test_set", "check_meta"), RUN)
    known = judged.filter("reason is null")
    absent = gt_presence(known.drop("reason"), gt).select(*RUN, "reason")
    fit = known.select(*RUN, "test_set")
    scores = dfr.dfr_score(files.join(fit, RUN, "left_semi"), gt, RUN, fit)
    rejected = judged.filter("reason is not null").select(*RUN, "reason").unionByName(absent)
    return scores.withColumnRenamed("tool_used", "run"), rejected.select(F.col("tool_used").alias("run"), "reason")


def _registry(spark: SparkSession, runs: DataFrame, gt: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    listed = read_registry_csv(spark, folder).withColumn("place", place(F.col("file")))
    asked = runs.withColumn("place", place(F.col("submitted_csv_path")))
    rows = asked.select("run", "base_test_case", "place").join(listed.drop("reason"), "place")
    faulty = listed.filter("reason is not null").groupBy("place").agg(F.min("reason").alias("reason"))
    scores = registry.registry_score(rows.select("base_test_case", F.col("run").alias("tool_used"), "path", "value"), gt)
    scores = scores.withColumnRenamed("tool_used", "run").join(asked.join(faulty, "place").select("run"), "run", "left_anti")
    # what has no score has a reason: no ground truth, a file without its columns, or one that is not there
    have = gt.select(case_key(F.col("base_test_case")).alias("_case")).distinct().withColumn("_gt", F.lit(True))
    rest = asked.join(scores.select("run"), "run", "left_anti").withColumn("_case", case_key(F.col("base_test_case")))
    rest = rest.join(have, "_case", "left").join(faulty, "place", "left").join(listed.select("place").distinct().withColumn("_file", F.lit(True)), "place", "left")
    reason = F.when(F.col("_gt").isNull(), "no ground truth").when(F.col("reason").isNotNull(), F.col("reason"))
    return scores, rest.select("run", reason.when(F.col("_file").isNull(), "no file or no rows at submitted_csv_path").otherwise("no entries").alias("reason"))


def _sqlite(spark: SparkSession, runs: DataFrame, gt: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    listed = F.col("task_id") == sqlite.LISTED_TASK
    cell = F.try_element_at("payload", F.lit("file_line"))
    # a list of lines is JSON within the JSON cell; anything else is a single line
    lines = F.coalesce(F.from_json(cell, "array<string>"), F.when(cell.isNotNull(), F.array(cell)), F.array().cast("array<string>"))
    asked = runs.select(
        F.col("run").alias("run_id"), "task_id", "base_test_case", "file_name", F.nullif("sqlite_table_name", F.lit("")).alias("sqlite_table_name"),
        F.when(~listed, F.col("payload")).alias("attributes"), F.when(listed, lines).alias("file_lines"),
    )
    scores = sqlite.sqlite_score(asked, gt).withColumnRenamed("run_id", "run")
    rest = runs.join(scores.select("run"), "run", "left_anti")
    known = F.col("task_id").isin(*sqlite.KEYED_TASKS, sqlite.LISTED_TASK)
    return scores, rest.select("run", F.when(known, "no ground truth").otherwise("unknown task_id").alias("reason"))


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(place, content, decodes, hash) of all files below a folder; files that are no images have no hash."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(place(F.col("path")).alias("place"), "content")
    images = image_lowfreq(read_images(spark, folder))
    hashed = images.select(place(F.col("path")).alias("place"), "decodes", F.when(F.col("decodes"), fingerprint64(F.col("values"))).alias("hash"))
    return content.join(hashed, "place", "left").withColumn("decodes", F.coalesce("decodes", F.lit(False)))


def _carving(spark: SparkSession, runs: DataFrame, gt: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """``gt`` has base_test_case, gt_id, gt_pos and ``path`` of the original, below ``folder`` as the carved files are."""
    facts = Scratch(spark).write(file_facts(spark, folder))
    originals = gt.withColumn("place", place(F.col("path"))).join(facts.drop("decodes"), "place", "left").select("base_test_case", "gt_id", "gt_pos", "content", "hash")
    named = runs.select("base_test_case", F.col("run").alias("tool_used"), F.posexplode("payload").alias("_n", "path"))
    subs = named.withColumn("sub_id", F.concat_ws(":", "tool_used", "_n")).withColumn("place", place(F.col("path"))).join(facts, "place", "left")
    details = carving.carving_details(subs.select(*RUN, "sub_id", "content", "hash", F.coalesce("decodes", F.lit(False)).alias("decodes")), originals)
    scores = carving.carving_score(details, originals).withColumnRenamed("tool_used", "run")
    return scores, gt_presence(runs, gt).select("run", "reason")


SUITES: dict[str, Callable[[SparkSession, DataFrame, DataFrame, str | None], tuple[DataFrame, DataFrame]]] = {
    "string_search": _string_search,
    "deleted_file_recovery": _deleted_files,
    "windows_registry": _registry,
    "sqlite_recovery": _sqlite,
    "file_carving": _carving,
}


def score_batch(spark: SparkSession, path: str | list[str], task: str, gt: DataFrame, folder: str | None = None) -> Batch:
    """Read, validate and score all runs of the batch CSV files at ``path`` against ``gt`` in the shape of the task's plan.

    ``folder`` holds the files that runs name: registry listings, or carved files and originals. The tables are written, as each is read several times.
    """
    scratch = Scratch(spark)
    rows = scratch.write(read_submission_batch(spark, path, task).withColumn("run", F.col("run_pos").cast("string")))
    unnamed = F.when(F.coalesce("tool_used", F.lit("")) == "", "missing tool_used")
    rows = rows.withColumn("reason", F.coalesce("reason", unnamed))
    scores, refused = SUITES[task](spark, rows.filter("reason is null").drop("reason"), gt, folder)
    names = rows.select("run", "run_pos", *RUN)
    counts = {c: F.col("rec" if c == "total_submitted_files" else c.lower()).alias(c) for c in SUMMARY_COUNTS} if task == "deleted_file_recovery" else {}
    scored = scratch.write(names.join(scores.select("run", *SCORES, *counts.values()), "run").withColumn("test_suite", F.lit(task)))
    results = scored.select("test_suite", "run_pos", *RUN, *SCORES)
    summary = scored.select("test_suite", "run_pos", "base_test_case", F.concat_ws("_", *RUN).alias("test_case"), F.col("f1").alias("score"), *counts)
    broken = rows.filter("reason is not null").select("run", "reason").unionByName(refused.select("run", "reason"))
    return Batch(results, scratch.write(names.join(broken, "run").select("run_pos", *RUN, "reason")), summary)
