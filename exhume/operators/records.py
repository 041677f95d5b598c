"""Records of generated scripts: prompt matrix, output counts, job summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.functions.metrics import count_true, ratio
from exhume.functions.text import render_prompt, script_suffix
from exhume.operators.ordered import rank_in_group

# The statuses a script may print after a path.
STATUSES = ("active", "deleted", "unallocated")


def first_n_prompts(prompts: DataFrame, source: list[str], pos: str, n: int) -> DataFrame:
    """The first ``n`` rows of each prompt file, in file order."""
    return rank_in_group(prompts, source, pos, "row_no").filter(F.col("row_no") <= n)


def prompt_matrix(prompts: DataFrame, templates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every job's first ``take_in_test_count`` prompts, rendered with its template.

    ``prompts`` has disk_image, pos and prompt; ``templates`` base_prompt_id and template; ``jobs``
    job_id, disk_image, disk_image_path, base_prompt_id, take_in_test_count and script_type. A job
    asks for row numbers 1..n, which meet numbered prompts by equality.
    """
    numbered = rank_in_group(prompts, ["disk_image"], "pos", "row_no").select("disk_image", "row_no", "prompt")
    n = F.col("take_in_test_count").cast("bigint")
    rows = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))
    wanted = jobs.withColumn("row_no", F.explode(rows))
    return (
        wanted.join(numbered, ["disk_image", "row_no"])
        .join(templates, "base_prompt_id")
        .select(
            "job_id", "row_no", "prompt",
            render_prompt(F.col("template"), F.col("prompt"), F.col("disk_image_path"), script_suffix(F.col("script_type"))).alias("rendered"),
        )
    )


def status_hits(outputs: DataFrame, keys: list[str], text: str = "output") -> DataFrame:
    """Lines ``path,status`` of a script's output counted by status; keeps runs without hits."""
    parts = F.split("_line", ",")
    lines = F.explode_outer(F.split(text, r"\r\n|\n|\r")).alias("_line")
    status = F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(1)), F.lit(" \t\r\f\v")))
    return (
        outputs.select(*keys, lines)
        .select(*keys, status.alias("_status"))
        .groupBy(*keys)
        .agg(*[count_true(F.col("_status") == s).alias(f"{s}_hits") for s in STATUSES])
    )


def job_summary(runs: DataFrame) -> DataFrame:
    """Per job, model and case: hits by status, executions, errors, shares and runs with a hit.

    ``runs`` has job_id, model, base_test_case, the three hit counts and error (empty = success).
    """
    hits = [F.col(f"{s}_hits") for s in STATUSES]
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    counted = runs.groupBy("job_id", "model", "base_test_case").agg(
        *[F.sum(h).alias(f"{s}_count") for s, h in zip(STATUSES, hits)],
        count_true(~failed).alias("success_executions"), count_true(failed).alias("error_executions"),
        F.count("*").alias("total_executions"), count_true(hits[0] + hits[1] + hits[2] > 0).alias("keywords_found"),
    )
    return counted.withColumn(
        "success_percentage", ratio(F.col("success_executions") * 100, F.col("total_executions"))
    ).withColumn("error_percentage", ratio(F.col("error_executions") * 100, F.col("total_executions")))
