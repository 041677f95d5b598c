"""Resampling towards a target distribution: hashed word counts give weights, Gumbel noise makes them a draw.

Two tables of bucket counts become one array of gains; every document's weight is the mean of its features' gains. Which
scores are drawn is found without sorting them all: a quantile sketch gives a bracket around the cutoff, exact counts outside
prove it (or widen it), and only the scores inside are put in order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exhume.llm.text_stats import fresh
from exhume.llm.worker import held
from exhume.session import Scratch

BUCKETS, LONGEST = 10_000, 1
SEED, PERCENT, MIN_WORDS = 2024, 10, 20
#: Quantiles of the bracket lie so far from the cutoff's at first; the sketch's own error is a tenth of it.
SLACK, ACCURACY = 0.001, 10_000
CACHED = 250_000
#: Lower case for A-Z; ASCII letters, digits and everything beyond ASCII are in words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Buckets(dict):
    """Buckets of features; emptied when full."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[feature] = value = zlib.crc32(feature) % self.buckets
        return value


def features(text: bytes, longest: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``longest`` words joined by a space."""
    words = text.translate(_FOLDED).split()
    return len(words), words + [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)]


def hashed(rows: DataFrame, text: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``rows`` without ``text``, with ``n_words``, ``n_features`` and the buckets of all features as unsigned 32-bit numbers in ``buckets``."""
    (name,) = fresh(rows, "text")
    kept = [c for c in rows.columns if c != text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = held(("buckets", buckets), lambda: _Buckets(buckets))
        for batch in batches:
            words, packed = [], []
            for t in batch.column(name).cast(pa.binary()):
                n, found = features(t.as_py() or b"", longest)
                words.append(n)
                packed.append(np.fromiter(map(bucket.__getitem__, found), "<u4", len(found)).tobytes())
            made = [pa.array(words, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, [*kept, "n_words", "n_features", "buckets"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.withColumnRenamed(text, name).mapInArrow(cut, f"{schema}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket over all rows. Each task sums up its own; one row per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    summed = featured.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in summed.collect():
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the source, rounded down."""
    s, t, n = float(source.sum()), float(target.sum()), float(len(source))
    ratio = ((x + 1.0) * (s + n) / ((y + 1.0) * (t + n)) for x, y in zip(target.tolist(), source.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with ``weight`` instead of its buckets: the mean gain of all features rounded down, 0 without any."""
    kept = [c for c in featured.columns if c != "buckets"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.frombuffer(b.as_py(), "<u4") for b in batch.column("buckets")]
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(weights, pa.int64())], [*kept, "weight"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in featured.schema if f.name in kept)
    return featured.mapInArrow(weigh, f"{schema}, weight bigint")


def noise(key: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of the seed and the key (a null key counts as empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def bracket(scored: DataFrame, total: int, wanted: int, score: str = "score", slack: float = SLACK) -> tuple[int, int, int]:
    """(low, high, above): the cutoff of the ``wanted`` highest of ``total`` scores lies from ``low`` to ``high``, and ``above`` scores are higher than that.

    Two quantiles of a sketch are proposed; the exact counts outside decide. A bracket that misses the cutoff is taken wider, at last from
    the least score to the highest.
    """
    value = F.col(score)
    share = 1 - wanted / total
    while True:
        ends = [min(1.0, max(0.0, share + s)) for s in (-slack, slack)]
        low, high = scored.agg(F.percentile_approx(value, ends, ACCURACY)).first()[0]
        if slack >= 1:
            low, high = scored.agg(F.min(value), F.max(value)).first()
        above, inside = scored.agg(F.count_if(value > high), F.count_if((value >= low) & (value <= high))).first()
        if above < wanted <= above + inside:
            return low, high, above
        slack *= 8


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, first: int = 0) -> DataFrame:
    """``rows`` with ``rank``, counted from ``first`` + 1 in ``order``, which should leave no ties.

    Ranges of the order are sorted each by itself; what lies before a range is a sum over one row per range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits number the ranges, the lower 33 the rows of each; written, so both stay as they are
    placed = scratch.write(sorted_.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row per range of the sort
    return numbered.withColumn("rank", (F.col("_before") + place + 1 + first).cast("bigint")).drop("_part", "_before", "_id")


def draw(scored: DataFrame, wanted: int, total: int, order: list[Column], scratch: Scratch) -> DataFrame:
    """The first ``wanted`` of the ``total`` rows of ``scored`` in ``order`` (which begins with the highest ``score``), with ``rank``."""
    low, high, above = bracket(scored, total, wanted)
    inside = ranked(scored.filter(F.col("score").between(low, high)), order, scratch, above).filter(F.col("rank") <= wanted)
    return ranked(scored.filter(F.col("score") > high), order, scratch).unionByName(inside)


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", percent: int = PERCENT,
    seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, carry, n_words, n_features, weight, score, rank) of every row of ``docs``; the drawn ones have a rank, from 1 for the highest score.

    Of all rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down) are drawn. Equal scores go by the smaller key, null keys
    last; equal keys in the order the rows are read. A null or empty text has no words: weight 0, never drawn where ``min_words`` is
    above 0. With an empty target all buckets weigh by their rarity; an empty table gives an empty one. ``carry`` names columns to keep, others
    are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    featured = scratch.write(hashed(rows, "_text", buckets, longest))
    count = partial(bucket_counts, buckets=buckets)
    gain = gains(count(featured), count(hashed(target.select(F.col(f"`{target_text}`").alias("_text"), F.lit(0).alias("_")), "_text", buckets, longest)))
    scores = weighted(featured, gain).withColumn("score", F.col("weight") + noise("key", seed))
    scores = scratch.write(scores.withColumn("tie", F.monotonically_increasing_id()))
    scratch.drop(featured)
    eligible = scores.filter(F.col("n_words") >= min_words).select("key", "score", "tie")
    total = eligible.count()
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("tie")]
    if wanted := percent * total // 100:
        ranks = draw(eligible, wanted, total, order, scratch).select("tie", "rank")
        scores = scores.join(ranks, "tie", "left")
    else:
        scores = scores.withColumn("rank", F.lit(None).cast("bigint"))
    return scores.select("key", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "n_features", "weight", "score", "rank")
