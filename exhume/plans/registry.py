"""Registry scoring (P6, J2, G5): PATH|VALUE entries of every run against its case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.metrics import ratio, with_prf
from exhume.functions.text import case_key
from exhume.operators.overlap import overlap_counts

RUN = ["base_test_case", "tool_used"]


def is_meta_row(path: Column) -> Column:
    """Report headers and summaries among the entries."""
    return F.coalesce(path.rlike("(?i)FILE_INFO|PROCESSING_SUMMARY"), F.lit(False))


def drop_meta_rows(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~is_meta_row(F.col(path)))


def entry_key(path: str = "path", value: str = "value") -> Column:
    def clean(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")), F.lit(" \t\n\r\f\v"))

    return F.concat(clean(path), F.lit("|"), clean(value))


def registry_score(sub: DataFrame, gt: DataFrame) -> DataFrame:
    case = case_key(F.col("base_test_case")).alias("_case")
    mine = drop_meta_rows(sub).select(*RUN, case, entry_key().alias("entry"))
    theirs = (
        drop_meta_rows(gt)
        .select(case, entry_key().alias("entry"))
        .groupBy("_case", "entry")
        .agg(F.count("*").alias("_gt_rows"))
    )
    gt_rows = theirs.groupBy("_case").agg(F.sum("_gt_rows").alias("total_ground_truth"))
    counts = overlap_counts(
        mine, theirs, RUN, ["_case"], "entry", {"total_submitted": F.sum("_rows")}
    ).join(gt_rows, "_case")
    return with_prf(counts).select(
        *RUN, "tp", "fp", "fn", "precision", "recall", "f1", "total_submitted", "total_ground_truth",
        ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("similarity_score"),
    )
