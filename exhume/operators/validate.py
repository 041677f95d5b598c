"""Runs that cannot be scored (V1-V3): they get a reason and go to quarantine, the job goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.text import case_key, null_token, parse_bool
from exhume.plans.dfr import NAME_SIZE_SETS, SIZE_SETS, TEST_SETS, TIME_SETS

# What each task needs, and the values its enumerated columns may take.
REQUIRED = {
    "string_search": ("base_test_case", "tool_used", "os"),
    "deleted_file_recovery": ("base_test_case", "tool_used", "test_set"),
    "file_carving": ("base_test_case", "tool_used"),
    "windows_registry": ("base_test_case", "tool_used"),
    "sqlite_recovery": ("task_id", "base_test_case", "file_name"),
}
ENUMS = {
    "type": ("active", "deleted", "unallocated"),
    "os": ("windows", "linux"),
    "cftt_task": (
        "string_search", "deleted_file_recovery", "file_carving", "windows_registry", "sqlite",
    ),
    "status": ("queued", "started", "ended", "hold", "code_generation", "code_execution"),
    "disk_image": ("windows_disk_path", "linux_disk_path"),
    "script_type": ("python", "shell"),
}


def missing_field(task: str) -> Column:
    """V1: reason naming the first missing field of a run, null when all are there."""
    reasons = [
        F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}"))
        for c in REQUIRED[task]
    ]
    return F.coalesce(*reasons)


def dfr_reasons(runs: DataFrame, files: DataFrame, run: list[str]) -> DataFrame:
    """V1 for deleted-file recovery: run columns and ``reason`` (null = fit to score).

    Duplicate names are found by counting (run, name) map-side, so a run holding a third of all
    files is still split by name.
    """
    test_set = F.upper(F.trim("test_set"))
    needs_size = test_set.isin(*SIZE_SETS, *NAME_SIZE_SETS)
    needs_time = test_set.isin(*TIME_SETS) & parse_bool(F.col("check_meta"))
    whole = lambda c: F.coalesce(F.col(c).rlike("^[+-]?[0-9]+$"), F.lit(False))
    stamps = ["deleted_timestamp", "modified_timestamp", "accessed_timestamp", "changed_timestamp"]
    untimed = ~whole(stamps[0])
    for c in stamps[1:]:
        untimed = untimed | ~whole(c)
    per_name = files.groupBy(*run, "file_name").agg(
        F.count("*").alias("_n"),
        F.bool_or(null_token(F.col("file_size")).isNull()).alias("_unsized"),
        F.bool_or(untimed).alias("_untimed"),
    )
    per_run = per_name.groupBy(*run).agg(
        F.bool_or(null_token(F.col("file_name")).isNull()).alias("_unnamed"),
        F.bool_or("_unsized").alias("_unsized"),
        F.bool_or("_untimed").alias("_untimed"),
        (F.max("_n") > 1).alias("_twice"),
    )
    reason = F.coalesce(
        missing_field("deleted_file_recovery"),
        F.when(~test_set.isin(*TEST_SETS), "invalid test_set"),
        F.when(F.col("_unnamed"), "missing file_name"),
        F.when(needs_size & F.col("_unsized"), "missing file_size"),
        F.when(needs_time & F.col("_untimed"), "missing timestamp"),
        F.when(F.col("_twice"), "duplicate file_name"),
    )
    return runs.join(per_run, run, "left").select(*runs.columns, reason.alias("reason"))


def gt_presence(runs: DataFrame, gt: DataFrame, scope: dict[str, str] | None = None) -> DataFrame:
    """V2: runs without ground truth, with the reason ``no ground truth``.

    ``scope`` maps run columns to ground-truth columns compared case-insensitively.
    """
    scope = scope or {"base_test_case": "base_test_case"}
    have = gt.select(*[case_key(F.col(g)).alias(f"_k{i}") for i, g in enumerate(scope.values())]).distinct()
    keyed = runs.select("*", *[case_key(F.col(r)).alias(f"_k{i}") for i, r in enumerate(scope)])
    keys = [f"_k{i}" for i in range(len(scope))]
    return keyed.join(have, keys, "left_anti").drop(*keys).withColumn("reason", F.lit("no ground truth"))


def single_gt_file(runs: DataFrame, gt: DataFrame) -> DataFrame:
    """V2 for the registry: a case must have exactly one ground-truth file."""
    files = gt.groupBy(case_key(F.col("base_test_case")).alias("_case")).agg(F.count("*").alias("_n"))
    reason = F.when(F.col("_n").isNull(), "no ground truth").when(
        F.col("_n") != 1, "more than one ground truth file"
    )
    return (
        runs.withColumn("_case", case_key(F.col("base_test_case")))
        .join(files, "_case", "left")
        .withColumn("reason", reason)
        .drop("_case", "_n")
    )


def in_enum(column: str) -> Column:
    """V3: the value is one the column may hold (any case, spaces around it ignored)."""
    return F.coalesce(F.lower(F.trim(column)).isin(*ENUMS[column]), F.lit(False))
