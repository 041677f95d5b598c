"""String-search scoring (G2): line ids of every run against the ground truth of its case and system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.functions.metrics import count_true, with_prf
from exhume.functions.text import LINE_TYPES, blank_to_null, case_key, line_id, norm_type
from exhume.operators.overlap import key_sets, overlap_counts

RUN = ["base_test_case", "os", "tool_used"]
SCOPE = ["_case", "_os"]


def line_map(gt: DataFrame) -> DataFrame:
    """Ground truth as line id -> type; blank ids are dropped, the last of several rows wins."""
    return (
        gt.select(
            case_key(F.col("base_test_case")).alias("_case"),
            case_key(F.col("os")).alias("_os"),
            blank_to_null(F.trim("file_line")).alias("file_line"),
            norm_type(F.col("type")).alias("type"),
            "gt_pos",
        )
        .filter(F.col("file_line").isNotNull())
        .groupBy("_case", "_os", "file_line")
        .agg(F.max_by("type", "gt_pos").alias("type"))
    )


def submitted_ids(sub: DataFrame) -> DataFrame:
    return sub.select(
        *RUN,
        case_key(F.col("base_test_case")).alias("_case"),
        case_key(F.col("os")).alias("_os"),
        line_id(F.col("line")).alias("file_line"),
    )


def string_search_score(sub: DataFrame, gt: DataFrame) -> DataFrame:
    hits = {f"hits_{t}": count_true(F.col("type") == t) for t in LINE_TYPES}
    counts = overlap_counts(submitted_ids(sub), line_map(gt), RUN, SCOPE, "file_line", hits)
    return with_prf(counts).select(
        *RUN,
        F.col("gt_total").alias("total_gt_lines"),
        F.col("sub_total").alias("total_submitted_lines"),
        "tp", "fp", "fn", "precision", "recall", "f1",
        *hits,
    )


def string_search_keys(sub: DataFrame, gt: DataFrame) -> DataFrame:
    return key_sets(submitted_ids(sub), line_map(gt), RUN + SCOPE, SCOPE, "file_line").drop(*SCOPE)
