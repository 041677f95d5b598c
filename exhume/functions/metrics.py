"""Precision, recall and F1 as column expressions (G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0.0 where the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def with_prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Add precision, recall and f1 from three count columns."""
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", ratio(F.col(tp), F.col(tp) + F.col(fp)))
        .withColumn("recall", ratio(F.col(tp), F.col(tp) + F.col(fn)))
        .withColumn("f1", ratio(2 * p * r, p + r))
    )


def count_true(condition: Column) -> Column:
    """count_if that is 0, never null."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("bigint")
