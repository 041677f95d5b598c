"""Best-fit packing of token sequences by exact complements, over the histogram of piece lengths.

Which lengths fill a sequence is settled on the counts of the at most ``capacity`` lengths; pieces of one length are
alike, so each is then placed by its rank among them. Only the histogram and the plan, both bounded by the
capacity, reach the driver.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exhume.llm.tokens import encoder
from exhume.session import Scratch

CAPACITY, SEPARATOR = 4096, 1
#: Ranks within a length stay below this, so that (length, rank) is one 64-bit number.
RANKS = 1 << 48


class Bins(NamedTuple):
    """``count`` equal sequences of ``items``: (length, how many of it)."""

    items: tuple[tuple[int, int], ...]
    count: int


class Sums:
    """Lengths still available, and how many ordered pairs and triples of them make each sum."""

    def __init__(self, left: np.ndarray) -> None:
        self.left, self.capacity = left, len(left) - 1
        self.single = (left > 0).astype(np.int64)
        self.pair = np.convolve(self.single, self.single)[: len(left)]
        self.triple = np.convolve(self.pair, self.single)[: len(left)]

    def _shifted(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        if by <= self.capacity:
            out[by:] = values[: len(values) - by]
        return out

    def take(self, items: Counter, times: int) -> None:
        for length, n in items.items():
            self.left[length] -= n * times
            if not self.left[length]:
                self._exhausted(length)

    def _exhausted(self, x: int) -> None:
        """Sums that need length ``x`` are no longer on offer."""
        self.single[x] = 0
        self.pair -= 2 * self._shifted(self.single, x)
        if 2 * x <= self.capacity:
            self.pair[2 * x] -= 1
        self.triple -= 3 * self._shifted(self.pair, x) + 3 * self._shifted(self.single, 2 * x)
        if 3 * x <= self.capacity:
            self.triple[3 * x] -= 1

    def times(self, items: Counter) -> int:
        return min(int(self.left[x]) // n for x, n in items.items())

    def _pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Available pairs of a sum, the most unequal first."""
        if total >= 2 and self.pair[total]:
            low = np.flatnonzero(self.single[: total // 2 + 1] * self.single[total - total // 2 : total + 1][::-1])
            for b in low.tolist():
                yield total - b, b

    def complement(self, length: int) -> Counter | None:
        """A single, pair or triple that with ``length`` makes exactly the capacity, as far as counts allow."""
        gap, own = self.capacity - length, Counter([length])
        if not gap:
            return own
        options = [(gap,)] if self.single[gap] else []
        for more in (options, self._pairs(gap), self._triples(gap)):
            for extra in more:
                items = own + Counter(extra)
                if self.times(items):
                    return items
        return None

    def _triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        if total >= 3 and self.triple[total]:
            first = np.flatnonzero(self.single[:total] * self.pair[1 : total + 1][::-1])
            for a in first[::-1].tolist():
                for b, c in self._pairs(total - a):
                    if b <= a:
                        yield a, b, c


def plan(counts: np.ndarray) -> list[Bins]:
    """Sequences for ``counts[length]`` pieces: exact complements from the longest down, best fit decreasing for the rest."""
    sums, capacity, full = Sums(counts.astype(np.int64)), len(counts) - 1, []
    for length in range(capacity, 0, -1):
        while sums.left[length] and (items := sums.complement(length)):
            times = sums.times(items)
            full.append(Bins(tuple(items.items()), times))
            sums.take(items, times)
    return full + _best_fit(sums.left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[Bins]:
    open_bins: dict[int, list[Bins]] = defaultdict(list)
    gaps: list[int] = []

    def put(bins: Bins, gap: int) -> None:
        if not open_bins[gap]:
            insort(gaps, gap)
        open_bins[gap].append(bins)

    for length in np.flatnonzero(left)[::-1].tolist():
        rest = int(left[length])
        while rest:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                for n, count in ((each, rest // each), (rest % each, 1)):
                    if n and count:
                        put(Bins(((length, n),), count), capacity - n * length)
                break
            gap = gaps[at]
            bins = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(at)
            # as many of the length into each of the group's sequences as fit
            each = min(gap // length, rest)
            count = min(bins.count, rest // each)
            if count < bins.count:
                put(Bins(bins.items, bins.count - count), gap)
            put(Bins((*bins.items, (length, each)), count), gap - each * length)
            rest -= count * each
    return [b for group in open_bins.values() for b in group]


def slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from rank ``key`` on, ``times`` to a sequence, from ``sequence`` and ``offset`` on."""
    rows, taken, sequence = [], Counter(), 0
    for items, count in bins:
        offset = 0
        for length, times in items:
            rows.append((length * RANKS + taken[length], times, sequence, offset))
            taken[length] += times * count
            offset += times * length
        sequence += count
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("key", "times", "sequence", "offset"), columns))


def cut_pieces(docs: DataFrame, vocabulary: str, text: str, key: str, separator: int, capacity: int) -> DataFrame:
    """Pieces of every row's ids (the separator included), with the task and the rank among its pieces of that length."""
    tail = struct.pack("<I", separator)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, origin = [], []
            for i, t in enumerate(batch.column(1)):
                ids = coder.encode(t.as_py()) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    rows.append((piece, at // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    origin.append(i)
            values = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin, pa.int64())), *map(pa.array, values)], ["key", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"key {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint")


def pack(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", separator: int = SEPARATOR, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all rows.

    Only documents above the capacity are cut, into pieces of the capacity and a last shorter one. A null or empty text
    is the separator alone, so every row has a piece; repeated rows and null keys are packed like any other;
    an empty table packs to nothing. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # ranks are counted within the task that cut the pieces, so they must be read from one written run of it
    pieces = scratch.write(cut_pieces(docs, vocabulary, text, key, separator, capacity))
    counted = pieces.groupBy("part", "length").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[r.length] = r.n
    places = spark.sparkContext.broadcast(slots(plan(histogram)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counted.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            wanted = length * RANKS + rank
            at = np.searchsorted(p["key"], wanted, "right") - 1
            nth = wanted - p["key"][at] if len(at) else wanted
            sequence = p["sequence"][at] + nth // p["times"][at]
            offset = p["offset"][at] + nth % p["times"][at] * length
            kept = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    placed = ranked.select("key", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"key {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    return placed.withColumn("piece", F.col("piece").cast("int")).withColumnRenamed("key", key)
