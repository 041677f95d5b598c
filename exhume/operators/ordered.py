"""Order-dependent helpers that hold when one group has a third of all rows.

A plain window over ``(group)`` sorts the whole group in one task. Positions here are integers, so
each group is cut into buckets of ``width`` consecutive positions: the window runs inside
``(group, bucket)`` and only one summary row per bucket takes part in the pass over the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exhume.session import stage

WIDTH = 1 << 20


def _bucket(pos: str, width: int) -> Column:
    return F.floor(F.col(pos) / F.lit(width)).cast("bigint")


def _with_heads(cut: DataFrame, heads: DataFrame) -> DataFrame:
    """``cut`` with the summary row of a bucket before its first row (``_head``), so that one window sees both and nothing is joined back."""
    return cut.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)), allowMissingColumns=True)


def rank_in_group(
    df: DataFrame, group: list[str], pos: str, out: str = "rn", width: int = WIDTH
) -> DataFrame:
    """Exact ``row_number() over (partition by group order by pos)``; null positions come first."""
    cut = df.withColumn("_b", _bucket(pos, width))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*group, "_b")
        .agg(F.count("*").alias("_n"))
        .select(*group, "_b", F.sum("_n").over(before).alias("_before"))
        .filter(F.col("_before").isNotNull())
    )
    inside = Window.partitionBy(*group, "_b").orderBy(F.desc("_head"), pos).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.sum(F.when(F.col("_head"), F.col("_before")).otherwise(1)).over(inside)
    return (
        _with_heads(cut, offsets).withColumn("_rank", counted.cast("bigint")).filter(~F.col("_head"))
        .drop("_b", "_before", "_head", *([out] if out in df.columns else [])).withColumnRenamed("_rank", out)
    )


def carry_forward(
    df: DataFrame, group: list[str], pos: str, value: Column, out: str, width: int = WIDTH
) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group."""
    return carry_all(df, group, pos, {out: value}, {}, width)


def carry_all(
    df: DataFrame, group: list[str], pos: str, last: dict[str, Column], before: dict[str, str], width: int = WIDTH
) -> DataFrame:
    """``last``: the last non-null value at or before each row of its group; ``before``: the largest value of a column among the rows before it.

    All of them in one pass. Of rows at one position, the smaller values of the columns in ``before`` come first.
    """
    cut = df.withColumn("_b", _bucket(pos, width)).withColumns({f"_l_{n}": c for n, c in last.items()})
    # null positions come first, as in the window
    place = F.struct(F.col(pos).isNotNull(), pos)
    taken = [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), place)).alias(f"_l_{n}") for n in last]
    taken += [F.max(c).alias(f"_m_{n}") for n, c in before.items()]
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in last]
    carried += [F.max(f"_m_{n}").over(earlier).alias(f"_m_{n}") for n in before]
    names = [*[f"_l_{n}" for n in last], *[f"_m_{n}" for n in before]]
    heads = cut.groupBy(*group, "_b").agg(*taken).select(*group, "_b", *carried)
    heads = heads.filter(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
    inside = Window.partitionBy(*group, "_b").orderBy(F.desc("_head"), pos, *before.values())
    upto, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns({f"_m_{n}": F.col(c) for n, c in before.items()}) if before else cut
    found = {f"_c_{n}": F.last(f"_l_{n}", ignorenulls=True).over(upto) for n in last} | {f"_c_{n}": F.max(f"_m_{n}").over(ahead) for n in before}
    outs = [*last, *before]
    return (
        _with_heads(rows, heads).withColumns(found).filter(~F.col("_head"))
        .select(*[c for c in df.columns if c not in outs], *[F.col(f"_c_{n}").alias(n) for n in outs])
    )


def islands(df: DataFrame, group: list[str], idx: str, width: int = WIDTH) -> DataFrame:
    """Maximal runs ``lo..hi`` of consecutive integers per group; ``idx`` is distinct in its group.

    Runs are found inside each bucket; only runs touching a bucket border (two per bucket at most)
    are stitched in the second pass.
    """
    cut = df.select(*group, F.col(idx).cast("bigint").alias("_i")).withColumn("_b", _bucket("_i", width))
    inside = Window.partitionBy(*group, "_b").orderBy("_i")
    local = (
        cut.withColumn("_g", F.col("_i") - F.row_number().over(inside))
        .groupBy(*group, "_b", "_g")
        .agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"))
        .drop("_g")
    )
    low, high = F.col("_b") * width, (F.col("_b") + 1) * width - 1
    at_border = (F.col("lo") == low) | (F.col("hi") == high)
    along = Window.partitionBy(*group).orderBy("lo")
    stitched = (
        local.filter(at_border)
        .withColumn("_new", (F.col("lo") != F.coalesce(F.lag("hi").over(along) + 1, F.lit(-1))).cast("int"))
        .withColumn("_g", F.sum("_new").over(along))
        .groupBy(*group, "_g")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_g")
    )
    return local.filter(~at_border).select(*group, "lo", "hi").unionByName(stitched.select(*group, "lo", "hi"))


def first_rows(df: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group by ``order``, as an aggregate so it combines map-side."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*group).agg(picked).select(*group, "_first.*")


def running_max_before(
    df: DataFrame, group: list[str], pos: str, value: str, out: str, width: int = WIDTH
) -> DataFrame:
    """Largest ``value`` among the rows before each row of its group (rows tie-broken by value)."""
    return carry_all(df, group, pos, {}, {out: value}, width)


def merge_intervals(
    df: DataFrame, group: list[str], start: str, end: str, width: int = WIDTH * 32
) -> DataFrame:
    """(group, lo, hi) unions of half-open intervals; touching ones merge."""
    bounds = df.select(*group, F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    seen = running_max_before(bounds, group, "_s", "_e", "_prior", width)
    opens = F.when(F.col("_prior").isNull() | (F.col("_s") > F.col("_prior")), F.col("_s"))
    # equal starts share the segment of the first of them, so the carried start is well defined; written, as the next pass reads it twice
    starts = stage(seen.withColumn("_open", opens).groupBy(*group, "_s").agg(F.max("_e").alias("_e"), F.min("_open").alias("_open")))
    led = carry_forward(starts, group, "_s", F.col("_open"), "lo", width)
    return led.groupBy(*group, "lo").agg(F.max("_e").alias("hi"))
