"""Look-ups by keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are split, and they have more rows than a part has at the least.
HEAVY_KEYS, PART_ROWS = 1000, 256


def heavy_keys(table: DataFrame, on: list[str], count: str) -> DataFrame:
    """(on, parts) of the keys that hold more than one in ``HEAVY_KEYS`` of all counted rows; so there are fewer than ``HEAVY_KEYS``."""
    total = table.agg(F.sum(count)).first()[0] or 0
    part = max(PART_ROWS, total // HEAVY_KEYS)
    return table.filter(F.col(count) > part).select(*on, F.ceil(F.col(count) / part).cast("int").alias("_parts"))


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key ``on`` and, in ``count``, how many of ``rows`` have it.

    The rows of a heavy key are dealt out over parts and its row of ``table`` is copied into each; all other keys are joined as they are.
    The list of heavy keys is broadcast: it has fewer than ``HEAVY_KEYS`` rows whatever the data. ``spread`` says which part a row goes to
    (by default its place in ``rows``, which should be a written table, so that it is the same when a task runs again). Null keys find nothing.
    """
    heavy = F.broadcast(heavy_keys(table, on, count))
    place = F.monotonically_increasing_id() if spread is None else spread
    dealt = rows.withColumn("_place", place).join(heavy, on, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod("_place", F.col("_parts")), F.lit(0)).cast("int")).drop("_place", "_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = table.join(heavy, on, "left").withColumn("_part", F.explode(parts)).drop("_parts", count)
    return dealt.join(copied.hint("merge"), [*on, "_part"], how).drop("_part")
