"""Checks for sources, sinks and the stream: views written to a shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from exhume.checks.fixtures import ORACLES, check, view, with_views
from exhume.checks.recovered_files import RUN, frames
from exhume.checks.text_search import REG, SS
from exhume.plans import dfr, registry, string_search
from exhume.sinks import results as K
from exhume.session import shared_folder, stage
from exhume.sources import inputs as A
from exhume.streaming import intake


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@check("read_ground_truth", with_views("ss_gt", "dfr_gt") + """
SELECT concat('FT-', base_test_case) AS base_test_case, file_line, type, gt_pos FROM ss_gt""")
def _(spark, d):
    """Both tasks in one table; only the string-search folder is read."""
    ss = view(spark, d, "ss_gt").select(F.concat(F.lit("FT-"), "base_test_case").alias("base_test_case"), "file_line", "type", "gt_pos")
    files = view(spark, d, "dfr_gt").select("base_test_case", "file_name", "gt_pos")
    both = ss.unionByName(files, allowMissingColumns=True).withColumn("cftt_task", F.lit(None).cast("string"))
    path = fresh(spark, "gt")
    A.write_ground_truth(both, path)
    return A.read_ground_truth(spark, path, "string_search", ["base_test_case", "file_line", "type", "gt_pos"])


@check("read_submission_batch", with_views("ss_sub") + """
SELECT base_test_case, os, tool_used, count(*) AS n_lines, CASE WHEN os = 'linux' AND tool_used = 'tool_b' THEN 'missing tool_used' END AS reason FROM ss_sub GROUP BY ALL""")
def _(spark, d):
    runs = view(spark, d, "ss_sub").groupBy("base_test_case", "os", "tool_used").agg(F.to_json(F.collect_list("line")).alias("file_contents_found"))
    rows = runs.withColumn("kept", F.col("tool_used")).withColumn(
        "tool_used", F.when((F.col("os") == "linux") & (F.col("tool_used") == "tool_b"), "  ").otherwise(F.col("tool_used"))
    )
    path = fresh(spark, "batch")
    rows.drop("kept").write.csv(path, header=True, escape='"')
    back = A.read_submission_batch(spark, path, "string_search")
    return back.select(
        "base_test_case", "os", F.coalesce(F.nullif("tool_used", F.lit("")), F.lit("tool_b")).alias("tool_used"),
        F.size("payload").cast("bigint").alias("n_lines"), "reason",
    )


@check("read_submission_json", with_views("dfr_sub") + """
SELECT base_test_case, tool_used, test_set, file_name, file_size, blocks FROM dfr_sub""")
def _(spark, d):
    """One JSON payload per run; half of them name the test set ``test_set_used``."""
    files = F.collect_list(F.struct("file_name", "file_size", "blocks")).alias("files")
    runs = view(spark, d, "dfr_sub").groupBy(*RUN, "test_set", "file_system").agg(files)
    odd = F.col("tool_used") == "tool_o"
    payloads = runs.withColumn("test_set_used", F.when(odd, F.col("test_set"))).withColumn("test_set", F.when(~odd, F.col("test_set")))
    path = fresh(spark, "payloads")
    payloads.repartition(96).write.option("maxRecordsPerFile", 1).json(path)
    back = A.read_submission_json(spark, path, repair_test_set=True)
    return back.select(*RUN, "test_set", F.explode("files").alias("f")).select(*RUN, "test_set", "f.file_name", "f.file_size", "f.blocks")


@check("read_registry_csv", REG)
def _(spark, d):
    """Registry scores from listings written as CSV, one folder per run; every other tool writes its columns in another order."""
    path = fresh(spark, "registry")
    sub = view(spark, d, "reg_sub").select(F.concat_ws("~", "base_test_case", "tool_used").alias("run"), F.col("path").alias("PATH "), F.col("value").alias("VALUE"), F.lit("x").alias("NOTE"))
    turned = F.crc32(F.col("run").cast("binary")) % 2 == 1
    for part in (sub.filter(~turned), sub.filter(turned).select("run", "NOTE", "VALUE", "PATH ")):
        part.write.mode("append").partitionBy("run").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    run = F.url_decode(F.regexp_extract("file", "run=([^/]*)/", 1))
    back = A.read_registry_csv(spark, path).withColumn("_run", F.split(run, "~"))
    listed = back.select(F.col("_run")[0].alias("base_test_case"), F.col("_run")[1].alias("tool_used"), "path", "value")
    return registry.registry_score(listed, view(spark, d, "reg_gt"))


@check("file_manifest", """SELECT concat('s_suppkey=', CAST(s_suppkey AS VARCHAR)) AS folder, strlen(s_name) + 1 AS size_bytes, 'text/plain' AS mime, sha256(concat(s_name, chr(10))) AS sha256 FROM supplier""")
def _(spark, d):
    """A file tree with one text file per supplier."""
    path = fresh(spark, "tree")
    # a number of tasks is named: by their few bytes all rows would go to one task, which makes a file for each
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    view(spark, d, "supplier").select("s_suppkey", "s_name").repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").text(path)
    found = A.file_manifest(spark, path)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "size_bytes", "mime", "sha256")


@check("batch_carving_reasons", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'empty files_json' WHEN s_suppkey % 3 = 1 THEN 'missing tool_used' END AS reason FROM supplier""")
def _(spark, d):
    """Carving runs as batch CSV, a third without any file and a third without tool; the columns of half of them are turned round."""
    k = F.col("s_suppkey")
    rows = view(spark, d, "supplier").select(
        F.concat(F.lit("carv-"), k.cast("string")).alias("base_test_case"), F.when(k % 3 == 1, "").otherwise("t").alias("tool_used"), F.lit("0").alias("write_db"),
        F.when(k % 3 == 0, "[]").otherwise('["/a/b.jpg"]').alias("files_json"), k.alias("k"),
    )
    path = fresh(spark, "carving-batch")
    rows.filter("k % 2 = 0").drop("k").write.csv(path, header=True, escape='"')
    rows.filter("k % 2 = 1").select("files_json", "write_db", "tool_used", "base_test_case").write.mode("append").csv(path, header=True, escape='"')
    back = A.read_submission_batch(spark, path, "file_carving")
    return back.select(F.substring("base_test_case", 6, 20).cast("bigint").alias("s_suppkey"), "reason")


@check("append_results", SS + """
SELECT 'string_search' AS task, base_test_case, concat(base_test_case, '_', os, '_', tool_used) AS test_case, '7' AS job_id, tp AS "TP", fp AS "FP", fn AS "FN", precision, recall, f1 AS "F1" FROM ss_score""")
def _(spark, d):
    scores = string_search.string_search_score(view(spark, d, "ss_sub"), view(spark, d, "ss_gt"))
    path = fresh(spark, "results")
    for _ in range(2):  # a job that runs again leaves one set of rows
        K.append_results(scores.withColumn("tool_used", F.concat_ws("_", "os", "tool_used")), path, "string_search", "7")
    return K.list_results(K.read_results(spark, path)).drop("created_at")


@check("list_results", SS + """
SELECT base_test_case, os, tool_used, f1 FROM ss_score WHERE base_test_case = 'SS-view'""")
def _(spark, d):
    scores = string_search.string_search_score(view(spark, d, "ss_sub"), view(spark, d, "ss_gt"))
    return K.list_results(scores, "ss-VIEW ", F.col("f1")).select("base_test_case", "os", "tool_used", "f1")


@check("write_reports", f"""SELECT base_test_case, rec AS total_submitted_files, tp AS "TP", fp AS "FP", fn AS "FN", precision, recall, f1 AS "F1", ss AS "SS", first AS "First", "full" AS "Full",
  match AS "Match", over AS "Over", multi AS "Multi", size_match AS "Size_match", test_set FROM ({ORACLES['dfr_score']})""")
def _(spark, d):
    """Summary CSV of all runs, read back."""
    scores = dfr.dfr_score(*frames(spark, d), RUN)
    path = fresh(spark, "reports")
    K.write_reports(scores, path)
    return spark.read.csv(f"{path}/summary", header=True, inferSchema=True).drop("job")


@check("write_reports_json", ORACLES["write_reports"])
def _(spark, d):
    """The JSON half of the reports, written twice by one job and read back."""
    scores = stage(dfr.dfr_score(*frames(spark, d), RUN))
    path = fresh(spark, "reports")
    for _ in range(2):
        K.write_reports(scores, path, "a/b 1")
    counts = ", ".join(f"`{c}` bigint" for c in ("total_submitted_files", "TP", "FP", "FN", "SS", "First", "Full", "Match", "Over", "Multi", "Size_match"))
    schema = f"base_test_case string, {counts}, precision double, recall double, F1 double, job string, test_set string"
    return spark.read.schema(schema).json(f"{path}/runs").drop("job")


@check("upsert_summary", """
WITH e AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat('DFR-', CAST(c_nationkey AS VARCHAR)) END AS base_test_case FROM customer)
SELECT base_test_case, score, total_submitted_files, 0 AS "SS", 0 AS "First", 0 AS "Full", 0 AS "Match", 0 AS "Over", multi AS "Multi", version FROM
(SELECT base_test_case, c_acctbal AS score, c_custkey * 2 AS total_submitted_files, c_custkey % 5 AS multi, c_custkey AS version, row_number() OVER (PARTITION BY base_test_case ORDER BY c_custkey DESC) AS r FROM e) WHERE r = 1 OR base_test_case = ''""")
def _(spark, d):
    rows = view(spark, d, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.concat(F.lit("DFR-"), F.col("c_nationkey").cast("string"))).alias("base_test_case"),
        F.col("c_acctbal").alias("score"), (F.col("c_custkey") * 2).alias("total_submitted_files"), (F.col("c_custkey") % 5).alias("Multi"),
        F.col("c_custkey").alias("version"),
    )
    old = rows.filter("version % 2 = 0")  # customers alternate between the old and the new file; both are kept whole
    return K.upsert_summary(old, rows.filter("version % 2 = 1").withColumnRenamed("Multi", "Mutli"))


@check("score_stream", SS + """
SELECT base_test_case, concat(base_test_case, '_', os, '_', tool_used) AS test_case, tp AS "TP", fp AS "FP", fn AS "FN", precision, recall, f1 AS "F1" FROM ss_score""")
def _(spark, d):
    """All runs as payload files, scored by the stream in several batches."""
    runs = view(spark, d, "ss_sub").groupBy("base_test_case", "os", "tool_used").agg(F.collect_list("line").alias("file_contents_found"))
    source, out, bad, mark = (fresh(spark, n) for n in ("arriving", "scored", "rejected", "stream"))
    runs.repartition(20).write.option("maxRecordsPerFile", 1).json(source)
    intake.score_stream(spark, source, view(spark, d, "ss_gt"), out, bad, mark, files_per_batch=8).awaitTermination()
    return spark.read.parquet(out).drop("task", "job_id", "batch")
