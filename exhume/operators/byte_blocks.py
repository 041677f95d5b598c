"""Block hashing, alignment and aligned match statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exhume.functions.blocks import let
from exhume.functions.kernels import correlate
from exhume.functions.metrics import ratio
from exhume.operators.chunks import chunked
from exhume.operators.ordered import islands, merge_intervals
from exhume.session import stage

SEGMENT = 2048
#: Blocks that one side has no oftener than this meet as rows, at most so many for each block of the other side.
FEW = 4

BLOCK = ["size", "hash"]
#: A block within a pair: a number of 64 bits in place of size and hash, which would be most of what a row weighs.
NAMED = ["_block"]


def named_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _block, index, offset, size) of blocks; those that have their number already stay as they are."""
    return blocks if "_block" in blocks.columns else blocks.select(*keys, F.xxhash64(*BLOCK).alias("_block"), "index", "offset", "size")


def byte_blocks(
    files: DataFrame,
    keys: list[str],
    content: str = "content",
    block_size: int = 512,
    stride: int | None = None,
    include_partial: bool = True,
    ignore_zero: bool = True,
) -> DataFrame:
    """(keys, index, offset, size, hash) of the blocks of each file.

    ``files`` are binary cells or chunk rows; these need ``block_size`` bytes behind their own where blocks reach over their ends.
    The index counts skipped all-zero blocks. Hashes are taken inside the array expression of one chunk, so
    bytes are never copied into block rows, and an array is as long as a chunk has blocks.
    """
    step = stride or block_size
    if step <= 0 or block_size <= 0:
        raise ValueError("block_size and stride must be positive")
    chunks = chunked(files, keys, content, behind=block_size)
    zeros = F.lit(bytes(block_size))

    def block(data: Column, i: Column) -> Column:
        size = F.least(F.lit(block_size), F.col("length") - i * step)
        piece = F.substring(data, (i * step - F.col("at") + 1).cast("int"), F.lit(block_size))
        zero = piece == F.substring(zeros, F.lit(1), size.cast("int"))
        return F.struct(
            i.alias("index"),
            (i * step).alias("offset"),
            size.cast("bigint").alias("size"),
            F.when(~zero if ignore_zero else F.lit(True), F.unhex(F.sha2(piece, 256))).alias("hash"),
        )

    # blocks belong to the chunk in which they begin
    first = F.ceil(F.col("at") / step)
    last = F.ceil((F.col("at") + F.col("own")) / step) - 1
    indices = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    # the bytes are bound once, as every look at the column would copy the chunk
    blocks = let(F.col("bytes"), lambda data: F.transform(indices, lambda i: block(data, i)))
    rows = chunks.select(*keys, F.inline(blocks)).filter(F.col("hash").isNotNull())
    return rows if include_partial else rows.filter(F.col("size") == block_size)


def block_hash_join(orig: DataFrame, carved: DataFrame, pair: list[str], by: list[str] = BLOCK) -> DataFrame:
    """Per (pair, size, hash) how often the block occurs on each side; ``by`` names a block otherwise.

    ``o_blocks * c_blocks`` is the number of candidate matches; no pair of blocks is materialised.
    """
    key = [*pair, *by]
    o = orig.groupBy(*key).agg(F.count("*").alias("o_blocks"))
    c = carved.groupBy(*key).agg(F.count("*").alias("c_blocks"))
    return o.join(c, key)


def _votes(orig: DataFrame, carved: DataFrame, counts: DataFrame, pair: list[str], stride: int) -> DataFrame:
    """Votes per pair and offset. Indices of equal blocks meet as rows where a side has few of them, else in lists of at most ``SEGMENT``."""
    key = [*pair, *NAMED]
    few = F.least("o_blocks", "c_blocks") <= FEW

    def indices(rows: DataFrame, idx: str) -> DataFrame:
        return rows.select(*key, F.col("index").alias(idx))

    def segments(rows: DataFrame, idx: str, out: str) -> DataFrame:
        listed = indices(rows, idx).join(counts.filter(~few).select(*key), key, "left_semi")
        return (
            listed.groupBy(*key, F.floor(F.col(idx) / SEGMENT).alias("_seg"))
            .agg(F.array_sort(F.collect_list(idx)).alias(out))
            .drop("_seg")
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in orig.select(*pair).schema)
    met = (
        segments(orig, "oi", "o_idx")
        .join(segments(carved, "ci", "c_idx"), key)
        .select(*pair, "o_idx", "c_idx")
        .mapInPandas(
            lambda frames: correlate(frames, pair), f"{fields}, d bigint, votes bigint, ci bigint, oi bigint"
        )
    )
    # an original given twice has one vote, as in the lists; the window is dealt and sorted like the join
    before = F.lag("oi").over(Window.partitionBy(*key).orderBy("oi"))
    once = indices(orig, "oi").withColumn("_again", F.coalesce(before == F.col("oi"), F.lit(False))).filter(~F.col("_again")).drop("_again")
    rows = counts.filter(few).select(*key).join(once, key).join(indices(carved, "ci"), key)
    single = rows.select(*pair, (F.col("oi") - F.col("ci")).alias("d"), F.lit(1).cast("bigint").alias("votes"), "ci", "oi")
    return met.unionByName(single).groupBy(*pair, "d").agg(
        F.sum("votes").alias("votes"), F.min(F.struct("ci", "oi")).alias("first")
    ).withColumn("offset", F.col("d") * stride)


def alignment_vote(orig: DataFrame, carved: DataFrame, pair: list[str], stride: int) -> DataFrame:
    """Most frequent ``orig_offset - carved_offset`` per pair, ties to the match seen first.

    Pairs without any equal block are absent (their offset is 0 with 0 votes).
    """
    orig, carved = named_blocks(orig, pair), named_blocks(carved, pair)
    counts = block_hash_join(orig, carved, pair, NAMED)
    votes = _votes(orig, carved, counts, pair, stride)
    best = F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.col("first.ci"), -F.col("first.oi")))
    totals = counts.groupBy(*pair).agg(F.sum(F.col("o_blocks") * F.col("c_blocks")).alias("candidates"))
    return votes.groupBy(*pair).agg(best.alias("_b")).select(*pair, "_b.offset", "_b.votes").join(totals, pair)


def aligned_matches(orig: DataFrame, carved: DataFrame, vote: DataFrame, pair: list[str]) -> DataFrame:
    """Matches at the voted offset: each carved block meets at most one original block."""
    orig, carved = named_blocks(orig, pair), named_blocks(carved, pair)
    o = orig.select(*pair, *NAMED, F.col("offset").alias("o_offset"), F.col("index").alias("o_index"))
    return (
        carved.select(*pair, *NAMED, "size", F.col("offset").alias("c_offset"), F.col("index").alias("c_index"))
        .join(vote.select(*pair, F.col("offset").alias("_off")), pair)
        .withColumn("o_offset", F.col("c_offset") + F.col("_off"))
        .join(o, [*pair, *NAMED, "o_offset"])
        .drop("_off")
    )


def aligned_match_stats(
    pairs: DataFrame, orig: DataFrame, carved: DataFrame, pair: list[str], stride: int
) -> DataFrame:
    """Alignment and match statistics of each pair; ``pairs`` has pair and o_bytes."""
    # read many times below: hash the files once, vote once
    orig, carved = stage(named_blocks(orig, pair)), stage(named_blocks(carved, pair))
    vote = stage(alignment_vote(orig, carved, pair, stride))
    aligned = stage(aligned_matches(orig, carved, vote, pair))
    o_total = orig.groupBy(*pair).agg(F.count("*").alias("original_blocks"))
    c_total = carved.groupBy(*pair).agg(F.count("*").alias("carved_blocks"))
    matched = aligned.groupBy(*pair).agg(
        F.count("*").alias("aligned_matches"),
        F.count_distinct("c_index").alias("matched_carved_blocks"),
        F.count_distinct("o_index").alias("matched_orig_blocks"),
    )
    runs = islands(aligned, pair, "c_index").groupBy(*pair).agg(
        F.max(F.col("hi") - F.col("lo") + 1).alias("longest_run_blocks")
    )
    cover = merge_intervals(
        aligned.select(*pair, "o_offset", (F.col("o_offset") + F.col("size")).alias("o_end")), pair, "o_offset", "o_end"
    ).groupBy(*pair).agg(
        F.sum(F.col("hi") - F.col("lo")).alias("covered_bytes"),
        F.max(F.col("hi") - F.col("lo")).alias("longest_run_bytes"),
    )
    out = pairs
    for part in (o_total, c_total, vote, matched, runs, cover):
        out = out.join(part, pair, "left")
    numbers = [
        "original_blocks", "carved_blocks", "offset", "votes", "candidates", "aligned_matches",
        "matched_carved_blocks", "matched_orig_blocks", "longest_run_blocks", "covered_bytes", "longest_run_bytes",
    ]
    return (
        out.fillna(0, numbers)
        .withColumn("block_match_rate", ratio(F.col("matched_carved_blocks"), F.col("carved_blocks")))
        .withColumn("recall_blocks", ratio(F.col("matched_orig_blocks"), F.col("original_blocks")))
        .withColumn("run_coverage", ratio(F.col("longest_run_bytes"), F.col("o_bytes")))
    )
