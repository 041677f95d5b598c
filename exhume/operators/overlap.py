"""Distinct-key overlap of submissions and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.metrics import count_true


def overlap_counts(
    sub: DataFrame,
    gt: DataFrame,
    run: list[str],
    scope: list[str],
    key: str,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Tp / fp / fn of distinct keys per run.

    ``scope`` (a subset of the run's columns) says which ground truth a run is scored on. Keys are
    collapsed map-side first, so a hot key is one row; ground truth is never copied per run, because
    fn = ground-truth keys of the scope - tp. Null keys keep a run alive without counting. Runs whose
    scope has no ground truth drop out (see ``validate.gt_presence``). ``extra`` adds aggregates over
    ``_rows`` (rows behind a key) and the columns of ``gt``.
    """
    found = sub.groupBy(*dict.fromkeys(run + scope + [key])).agg(F.count("*").alias("_rows"))
    totals = gt.groupBy(*scope).agg(F.count("*").alias("gt_total"))
    hit = F.col("_hit").isNotNull()
    named = F.col(key).isNotNull()
    per_run = (
        found.join(gt.withColumn("_hit", F.lit(1)), [*scope, key], "left")
        .groupBy(*dict.fromkeys(run + scope))
        .agg(
            count_true(named).alias("sub_total"),
            count_true(hit).alias("tp"),
            count_true(named & ~hit).alias("fp"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )
    return per_run.join(totals, scope).withColumn("fn", F.col("gt_total") - F.col("tp"))


def key_sets(sub: DataFrame, gt: DataFrame, run: list[str], scope: list[str], key: str) -> DataFrame:
    """O1: every key of a run with its status TP, FP or FN."""
    mine = sub.filter(F.col(key).isNotNull()).select(*run, key).distinct().withColumn("_s", F.lit(1))
    runs = sub.select(*run).distinct()
    theirs = gt.select(*scope, key).distinct().join(runs, scope).withColumn("_g", F.lit(1))
    status = (
        F.when(F.col("_g").isNull(), "FP").when(F.col("_s").isNull(), "FN").otherwise("TP")
    )
    return mine.join(theirs, [*run, key], "full").select(*run, key, status.alias("status"))
