"""Byte and bit comparison of file pairs.

Files (binary cells or chunk rows) are brought into pieces keyed (pair, number); the two sides meet by an equi-join on
that key, so one huge file is spread over many tasks. A kernel reduces a chunk pair to one small row, and runs that
cross chunk borders are stitched by an ordered fold of (n, prefix, suffix, best) summaries.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.kernels import LOCKSTEP_COLUMNS, compare_lockstep, compare_overlap
from exhume.functions.metrics import ratio
from exhume.operators.chunks import CHUNK, chunked, lengths, regrid

def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def byte_compare(
    orig: DataFrame, carved: DataFrame, keys: list[str], offset: str = "offset", chunk: int = CHUNK
) -> DataFrame:
    """Compare with the original shifted by ``offset`` (one of the ``keys``; 0 = lockstep).

    Bytes past the overlap are unequal; bits are compared inside the overlap only. Two empty tails
    have similarity 1.
    """
    zero = F.lit(0).cast("bigint")
    o_start, c_start = F.greatest(F.col(offset), zero), F.greatest(-F.col(offset), zero)
    orig, carved = chunked(orig, keys, size=chunk), chunked(carved, keys, size=chunk)
    sides = lengths(orig, keys, "o_bytes").withColumn("orig_start", o_start).join(
        lengths(carved, keys, "c_bytes").withColumn("carved_start", c_start), keys
    )
    chunks = regrid(orig, keys, o_start, "a", chunk).join(regrid(carved, keys, c_start, "b", chunk), [*keys, "chunk_no"])
    row = [*keys, "chunk_no"]
    stats = chunks.mapInPandas(
        partial(compare_overlap, keys=row),
        f"{_fields(orig, keys)}, chunk_no bigint, diff bigint, bits bigint, first bigint, n bigint, pre bigint, suf bigint, best bigint",
    )
    sums = stats.groupBy(*keys).agg(
        F.sum("diff").alias("_diff"), F.sum("bits").alias("diff_bits"),
        F.min(F.col("chunk_no") * chunk + F.col("first")).alias("_first"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "n", "pre", "suf", "best"))).alias("_runs"),
    ).withColumn("longest_equal_run", longest_from_list(F.col("_runs"))).drop("_runs")
    o_tail = F.greatest(F.col("o_bytes") - F.col("orig_start"), zero)
    c_tail = F.greatest(F.col("c_bytes") - F.col("carved_start"), zero)
    return (
        sides.join(sums, keys, "left")
        .withColumn("total_bytes", F.greatest(o_tail, c_tail))
        .withColumn("overlap", F.least(o_tail, c_tail))
        .withColumn("diff_bits", F.coalesce("diff_bits", zero))
        .withColumn("diff_bytes", F.coalesce("_diff", zero) + F.col("total_bytes") - F.col("overlap"))
        .withColumn("byte_similarity", F.lit(1.0) - ratio(F.col("diff_bytes"), F.col("total_bytes")))
        .withColumn("first_diff", F.coalesce("_first", F.when(F.col("total_bytes") > F.col("overlap"), F.col("overlap"))))
        .withColumn("first_diff_orig", F.col("orig_start") + F.col("first_diff"))
        .withColumn("first_diff_carved", F.col("carved_start") + F.col("first_diff"))
        .withColumn("longest_equal_run", F.coalesce("longest_equal_run", zero))
        .withColumn("bit_error_rate", F.when(F.col("overlap") > 0, F.col("diff_bits") / (8 * F.col("overlap"))))
        .drop("_diff", "_first", "orig_start", "carved_start")
    )


def longest_from_list(runs: Column) -> Column:
    """W3 on an ordered list of summaries, one for each chunk of a file."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("cur"), zero.alias("best"))
    step = lambda a, b: F.struct(
        F.when(b["pre"] == b["n"], a["cur"] + b["n"]).otherwise(b["suf"]).alias("cur"),
        F.greatest(a["best"], a["cur"] + b["pre"], b["best"]).alias("best"),
    )
    return F.aggregate(runs, start, step, lambda a: a["best"])


def lockstep_compare(
    left: DataFrame, right: DataFrame, keys: list[str], block: int = 512, align: int = 0, chunk: int = CHUNK
) -> DataFrame:
    """G12-G14 in one pass: bytes, bits, padded blocks and recovered share, from ``align`` on in both.

    ``left`` is the carved file, ``right`` the original whose size the recovery percentages refer to.
    """
    if block <= 0 or align < 0:
        raise ValueError("block must be positive and align not negative")
    chunk = max(1, chunk // block) * block  # blocks never straddle chunks
    start = F.lit(align)
    left, right = chunked(left, keys, size=chunk), chunked(right, keys, size=chunk)
    sizes = lengths(left, keys, "size_a").join(lengths(right, keys, "size_b"), keys)
    row = [*keys, "chunk_no"]
    chunks = regrid(left, keys, start, "a", chunk).join(regrid(right, keys, start, "b", chunk), row, "full")
    types = ", ".join(f"{c} bigint" for c in LOCKSTEP_COLUMNS)
    stats = chunks.mapInPandas(
        partial(compare_lockstep, keys=row, block=block), f"{_fields(left, keys)}, chunk_no bigint, {types}"
    )
    per = chunk // block
    runs = lambda *c: longest_from_list(
        F.array_sort(F.collect_list(F.struct("chunk_no", *[F.col(x).alias(y) for x, y in zip(c, ("n", "pre", "suf", "best"))])))
    )
    sums = stats.groupBy(*keys).agg(
        F.sum("diff").alias("diff_bytes"), F.min(F.col("chunk_no") * chunk + F.col("first")).alias("first_diff"),
        runs("n", "pre", "suf", "best").alias("longest_equal_bytes"),
        F.sum("bits").alias("diff_bits"), F.min(F.col("chunk_no") * chunk * 8 + F.col("first_bit")).alias("first_diff_bit"),
        runs("bn", "bpre", "bsuf", "bbest").alias("longest_equal_bits"),
        F.sum("kn").alias("total_blocks"), F.sum("equal_blocks").alias("matching_blocks"),
        F.min(F.col("chunk_no") * per + F.col("first_block")).alias("first_mismatch_block"),
        runs("kn", "kpre", "ksuf", "kbest").alias("longest_equal_blocks"),
        F.sum("same_blocks").alias("recovered_blocks"), F.sum("same_bytes").alias("recovered_bytes"),
    )
    counts = [
        "diff_bytes", "longest_equal_bytes", "diff_bits", "longest_equal_bits", "total_blocks", "matching_blocks",
        "longest_equal_blocks", "recovered_blocks", "recovered_bytes",
    ]
    shift = lambda c: F.greatest(F.col(c) - align, F.lit(0).cast("bigint"))
    longer = F.greatest(shift("size_a"), shift("size_b"))
    one_if_none = lambda n, d: F.when(d == 0, F.lit(1.0)).otherwise(n / d)
    whole_blocks = F.floor(F.col("size_b") / block)
    return (
        sizes.join(sums, keys, "left").fillna(0, counts)
        .withColumn("byte_similarity", F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.col("diff_bytes") / longer))
        .withColumn("bit_error_rate", ratio(F.col("diff_bits"), longer * 8))
        .withColumn("longest_equal_bits_fraction", one_if_none(F.col("longest_equal_bits"), longer * 8))
        .withColumn("block_match_rate", one_if_none(F.col("matching_blocks"), F.col("total_blocks")))
        .withColumn("longest_equal_blocks_fraction", ratio(F.col("longest_equal_blocks"), F.col("total_blocks")))
        .withColumn("byte_recovery_pct", ratio(F.col("recovered_bytes"), F.col("size_b")) * 100)
        .withColumn("block_recovery_pct", ratio(F.col("recovered_blocks"), whole_blocks) * 100)
    )
