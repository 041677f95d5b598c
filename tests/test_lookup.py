"""Look-ups with heavy keys."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from exhume.operators import lookup
from exhume.session import stage


def test_heavy_keys_are_split_and_rows_stay_whole(spark):
    rows = stage(spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 997).alias("k"), "id"))
    table = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("k"), "k"))
    heavy = lookup.heavy_keys(table, ["k"], "n").collect()
    assert [r.k for r in heavy] == [7] and heavy[0]["_parts"] > 20
    got = lookup.lookup_join(rows, table, ["k"], "n").collect()
    assert len(got) == rows.filter("k is not null").count() == len({r.id for r in got}) and all(r.name == f"k{r.k}" for r in got)
    left = lookup.lookup_join(rows, table.filter("k <> 5"), ["k"], "n", "left").collect()
    assert len(left) == 20_000 and all((r.name is None) == (r.k is None or r.k == 5) for r in left)
    # no part of the split key has more rows than PART_ROWS allows for
    dealt = Counter(i % heavy[0]["_parts"] for i in range(sum(r.k == 7 for r in got)))
    assert max(dealt.values()) <= lookup.PART_ROWS + 1


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a")], "k bigint, v string")
    table = rows.select("k", F.lit(1).cast("bigint").alias("n"), F.lit("x").alias("name"))
    assert lookup.lookup_join(rows.filter("false"), table, ["k"], "n").count() == 0
    assert lookup.lookup_join(rows, table.filter("false"), ["k"], "n", "left").collect()[0].name is None
