"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.session import Scratch


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its neighbours; sums before the exchange, so that a hub is no burden."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: bigint); the component is its least node.

    Rounds grow with the logarithm of the longest path. Each is a written table, so lost executors cost little.
    """
    tidy = lambda e: e.filter("u <> v").distinct()
    sums = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = scratch.write(tidy(edges.select("u", "v")))
    state = sums(now)
    while state[0]:
        after = scratch.write(tidy(_small_star(tidy(_large_star(now)))))
        scratch.drop(now)
        now, before, state = after, state, sums(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
