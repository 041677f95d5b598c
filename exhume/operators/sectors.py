"""Sector ranges, partitions and unit sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from exhume.functions import blocks as B

SECTOR = 512
# Candidate unit sizes in bytes, most usual first (the order breaks ties).
UNIT_SIZES = (4096, 2048, 1024, 8192, 16384, 32768, 65536, 512)
MAX_OVER_COVERAGE = 64
#: Numbers beyond this are left to array expressions, which report overflows.
SMALL = 1 << 50


def partition_table(parts: DataFrame, scope: list[str]) -> DataFrame:
    """One row per image with its partitions in start order: ``array<struct<start,end,name>>``.

    A partition scheme holds a fixed number of entries (4 for MBR, 128 for GPT by default), so the
    list belongs to the image, not to the files looked up in it.
    """
    item = F.struct("start", "end", "name")
    return parts.groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("parts"))


def _holding(parts: Column, sector: Column) -> Column:
    return F.get(F.filter(parts, lambda p: (p["start"] <= sector) & (sector <= p["end"])), F.lit(0))["name"]


@F.arrow_udf(ArrayType(IntegerType()))
def _touched(ranges: pa.Array, starts: pa.Array, ends: pa.Array, names: pa.Array) -> pa.Array:
    """The names that a row's ranges touch, as numbers out of ``names``; null for rows with a null or a very large number in a range.

    Partitions are in start order, so the first one whose end, or an earlier one's, reaches a sector is the only candidate: bisection finds it,
    for all ranges of a batch side by side.
    """
    lists, low, high, named = (x.fill_null([]) if x.null_count else x for x in (ranges, starts, ends, names))
    counts, sizes = np.diff(lists.offsets.to_numpy()), np.diff(low.offsets.to_numpy())
    flat, row, n = lists.flatten(), np.repeat(np.arange(len(counts)), counts), len(counts)
    limits = np.iinfo(np.int64)
    whole = lambda x, missing: x.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)
    s, e = (whole(flat.field(i), limits.max) for i in (0, 1))
    far = (s < -SMALL) | (s > SMALL) | (e < -SMALL) | (e > SMALL)
    odd = np.bincount(row[far], minlength=n) > 0
    s, e = np.where(far, 0, s), np.where(far, 0, e)
    begin, reach, number = whole(low.flatten(), limits.max), whole(high.flatten(), limits.min), whole(named.flatten(), -1)
    reach = np.where(begin == limits.max, limits.min, reach)  # one without a start holds nothing, and stands before the others
    base = np.concatenate([[0], np.cumsum(sizes)])
    # the largest end so far in each row, by steps of 1, 2, 4, ...
    inside, step = np.arange(len(reach)) - np.repeat(base[:-1], sizes), 1
    while len(reach) and step <= inside.max():
        reach = np.where(inside >= step, np.maximum(reach, np.concatenate([reach[:step], reach[:-step]])), reach)
        step *= 2

    def name(x: np.ndarray) -> np.ndarray:
        at, stop = base[row], base[row + 1]
        end, last = stop, len(reach) - 1
        if last < 0:
            return np.full(len(x), -1)
        while (at < stop).any():
            middle = np.minimum((at + stop) // 2, last)
            short = reach[middle] < x
            at, stop = np.where((at < stop) & short, middle + 1, at), np.where((at < stop) & ~short, middle, stop)
        place = np.minimum(at, last)
        return np.where((at < end) & (begin[place] <= x), number[place], -1)

    a, b = name(s), name(e)
    middle = np.where((a == b) & (a >= 0), -1, name((s + e) // 2))
    found = np.concatenate([a, b, middle])
    width = int(sizes.max(initial=0)) + 1
    codes = np.unique((np.tile(row, 3) * width + found)[found >= 0])
    offsets = np.searchsorted(codes // width, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((codes % width).astype(np.int32)), mask=pa.array(odd))


def sector_to_partition(files: DataFrame, parts: DataFrame, scope: list[str], ranges: str = "ranges") -> DataFrame:
    """Add ``partitions`` (sorted, ``|``-joined) and ``status`` to files with sector ranges.

    A range with both ends in one partition lies there; otherwise its start, end and middle are
    looked up. A partition lying between the probes is not seen. Batches of rows are looked up by a kernel;
    rows with a null or very large numbers by array expressions.
    """
    table = F.col("parts")

    def touched(r: Column) -> Column:
        return B.let(
            F.struct(_holding(table, r["s"]).alias("a"), _holding(table, r["e"]).alias("b")),
            lambda p: F.when(p["a"] == p["b"], F.array(p["a"])).otherwise(
                F.array(p["a"], p["b"], _holding(table, B.floor_div(r["s"] + r["e"], F.lit(2))))
            ),
        )

    by_row = F.array_distinct(F.array_compact(F.flatten(F.transform(ranges, touched))))
    # a name's number is its first place in the image's list
    numbers = F.transform("parts.name", lambda n: (F.array_position("parts.name", n) - 1).cast("int"))
    images = partition_table(parts, scope).withColumns(
        {"_starts": F.col("parts.start").cast("array<bigint>"), "_ends": F.col("parts.end").cast("array<bigint>"), "_numbers": numbers}
    )
    joined = files.join(images, scope, "left").withColumn("_touched", _touched(ranges, "_starts", "_ends", "_numbers"))
    by_kernel = F.transform("_touched", lambda i: F.get(table, i)["name"])
    names = F.array_sort(F.when(F.col("_touched").isNull(), by_row).otherwise(by_kernel))
    joined = joined.withColumn("_names", F.coalesce(names, F.array().cast("array<string>")))
    status = F.when(F.size("_names") == 0, "NO_MATCH").when(F.size("_names") == 1, "OK").otherwise("CROSSES_PARTITIONS")
    return joined.withColumn("partitions", F.array_join("_names", "|")).withColumn("status", status).drop("parts", "_names", "_touched", "_starts", "_ends", "_numbers")


def pick_partition(files: DataFrame, parts: DataFrame, scope: list[str], ranges: str = "ranges") -> DataFrame:
    """Add the first partition holding all ranges, else the first holding their start, else null."""
    low = F.array_min(F.transform(ranges, lambda r: r["s"]))
    high = F.array_max(F.transform(ranges, lambda r: r["e"]))
    whole = F.filter("parts", lambda p: (p["start"] <= low) & (high <= p["end"]))
    begin = F.filter("parts", lambda p: (p["start"] <= low) & (low <= p["end"]))
    picked = F.coalesce(F.get(whole, F.lit(0)), F.get(begin, F.lit(0)))
    return (
        files.join(partition_table(parts, scope), scope, "left")
        .withColumn("_p", picked)
        .withColumn("part_start", F.col("_p.start"))
        .withColumn("part_name", F.col("_p.name"))
        .drop("_p", "parts")
    )


def _unit_count(sectors: Column, start: Column, spu: int | Column) -> Column:
    """Units touched by sorted disjoint ranges: neighbours can share one unit at most, so one pass does."""
    per = F.lit(spu).cast("bigint") if isinstance(spu, int) else spu
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last"))

    def step(acc: Column, r: Column) -> Column:
        low, high = B.floor_div(r["s"] - start, per), B.floor_div(r["e"] - start, per)
        again = F.coalesce(acc["last"] == low, F.lit(False)).cast("bigint")
        return F.struct((acc["n"] + high - low + 1 - again).alias("n"), high.alias("last"))

    return F.aggregate(sectors, none, step, lambda acc: acc["n"])


def _gcd_sectors(ranges: Column) -> Column:
    """Greatest common divisor of the run lengths (0 without runs)."""

    def euclid(a: Column, b: Column) -> Column:
        # 92 remainders end for any two 64-bit numbers
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(92)),
            F.struct(a.alias("a"), b.alias("b")),
            lambda p, _i: F.when(p["b"] == 0, p).otherwise(
                F.struct(p["b"].alias("a"), F.pmod(p["a"], F.greatest(p["b"], F.lit(1).cast("bigint"))).alias("b"))
            ),
            lambda p: p["a"],
        )

    lengths = F.transform(ranges, lambda r: r["e"] - r["s"] + 1)
    return F.aggregate(
        lengths, F.lit(0).cast("bigint"),
        lambda acc, n: F.when(acc == 0, n).when(F.pmod(n, acc) == 0, acc).otherwise(euclid(acc, n)),
    )


def _best_units(ranges: pa.Array, start: pa.Array, size: pa.Array, gcd_hint: bool) -> pa.Array:
    """The unit size of each row of a batch; null where a row has no ranges. All rows are scored side by side, one candidate after the other."""
    lists = ranges.fill_null([]) if ranges.null_count else ranges
    counts = np.diff(lists.offsets.to_numpy())
    flat, row = lists.flatten(), np.repeat(np.arange(len(counts)), counts)
    low, high = (flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    first = start.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bytes_ = size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(counts)

    def total(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(values)])
        at = np.searchsorted(rows, np.arange(n + 1))
        return ends[at[1:]] - ends[at[:-1]]

    # as in merge_ranges: starts and ends sorted independently, parted where a gap follows
    starts, ends = low[np.lexsort((low, row))], high[np.lexsort((high, row))]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (starts[1:] > ends[:-1] + 1)
    begin = np.flatnonzero(new)
    m_row, m_low, m_high = row[begin], starts[begin], ends[np.append(begin[1:], len(row)) - 1] if len(begin) else ends[:0]
    again_row = np.zeros(len(m_row), bool)
    again_row[1:] = m_row[1:] == m_row[:-1]
    covered = total(high - low + 1, row)
    common = np.zeros(n, np.int64)
    some = np.flatnonzero(counts)
    if gcd_hint and len(some):
        common[some] = np.gcd.reduceat(high - low + 1, np.concatenate([[0], np.cumsum(counts)[:-1]])[some])
    best, chosen = None, np.zeros(n, np.int64)
    for rank, unit in enumerate(UNIT_SIZES):
        spu = unit // SECTOR
        a, b = (m_low - first[m_row]) // spu, (m_high - first[m_row]) // spu
        again = np.zeros(len(a), np.int64)
        again[1:] = again_row[1:] & (b[:-1] == a[1:])
        units = total(b - a + 1 - again, m_row)
        misaligned = total(((low - first[row]) % spu != 0).astype(np.int64), row) > 0
        fits = (bytes_ != 0) & (units == np.where(bytes_ > 0, (bytes_ + unit - 1) // unit, 0))
        over = np.maximum(0, units * spu - covered)
        if gcd_hint:
            over = np.where(common == spu, np.maximum(0, over - 1), over)
        score = (~fits).astype(np.int64) * 2 + misaligned
        better = np.ones(n, bool) if best is None else (score < best[0]) | ((score == best[0]) & (over < best[1]))
        best = (score, over) if best is None else (np.where(better, score, best[0]), np.where(better, over, best[1]))
        chosen = np.where(better, unit, chosen)
    return pa.array(chosen, pa.int64(), mask=counts == 0)


@F.arrow_udf(LongType())
def _plain_fit(ranges: pa.Array, start: pa.Array, size: pa.Array) -> pa.Array:
    return _best_units(ranges, start, size, False)


@F.arrow_udf(LongType())
def _gcd_fit(ranges: pa.Array, start: pa.Array, size: pa.Array) -> pa.Array:
    return _best_units(ranges, start, size, True)


def infer_unit_size(ranges: Column, start: Column, size: Column, gcd_hint: bool = False) -> Column:
    """The candidate unit size that fits best.

    Order: block count equals ceil(size / unit), starts aligned, least over-coverage, usual sizes
    first. Without a size the count never fits. ``gcd_hint`` lowers the over-coverage of the candidate
    equal to the gcd of the run lengths by one. Batches of rows are scored by a kernel on flat numbers; rows with a
    null, a reversed range or very large numbers by array expressions.
    """
    far = lambda c: F.coalesce(~c.between(-SMALL, SMALL), F.lit(True))
    odd = F.exists(ranges, lambda r: far(r["s"]) | far(r["e"]) | F.coalesce(r["e"] < r["s"], F.lit(True))) | far(start) | ~F.coalesce(size, F.lit(0)).between(-SMALL, SMALL)
    fast = _gcd_fit if gcd_hint else _plain_fit
    wide = F.coalesce(size, F.lit(0)).cast("bigint")
    return F.when(F.coalesce(odd, F.lit(False)), _infer_row(ranges, start, size, gcd_hint)).otherwise(fast(ranges, start.cast("bigint"), wide))


def _infer_row(ranges: Column, start: Column, size: Column, gcd_hint: bool) -> Column:
    """The same by array expressions inside the row."""
    zero = F.lit(0).cast("bigint")
    known = size.isNotNull() & (size != 0)

    def score(rank: int, unit: int, facts: Column) -> Column:
        spu = unit // SECTOR
        count = _unit_count(facts["sectors"], start, spu)
        misaligned = F.exists(ranges, lambda r: F.pmod(r["s"] - start, F.lit(spu)) != 0).cast("int")

        def ordered(n: Column) -> Column:
            fits = F.coalesce(known & (n == B.expected_units(size, F.lit(unit).cast("bigint"))), F.lit(False))
            over = F.greatest(zero, n * spu - facts["total"])
            if gcd_hint:
                over = F.when(facts["gcd"] == spu, F.greatest(zero, over - 1)).otherwise(over)
            return F.struct(
                F.when(fits, 0).otherwise(1).alias("d"), misaligned.alias("m"), over.alias("o"),
                F.lit(rank).alias("r"), F.lit(unit).alias("u"),
            )

        return B.let(count, ordered)

    facts = F.struct(
        B.merge_ranges(ranges).alias("sectors"), B.range_count(ranges).alias("total"),
        (_gcd_sectors(ranges) if gcd_hint else zero).alias("gcd"),
    )
    best = B.let(facts, lambda f: F.array_min(F.array(*[score(i, u, f) for i, u in enumerate(UNIT_SIZES)])))
    return F.when(F.size(ranges) > 0, best["u"]).cast("bigint")


def validate_geometry(ranges: Column, start: Column, size: Column, unit: Column) -> Column:
    """struct(unit_size, source) - the given unit size where it is consistent, else the inferred one.

    A given size is dropped when the block count contradicts a known file size, a start is
    misaligned, or more than 64 sectors too many are covered.
    """
    given = F.coalesce(unit, F.lit(0).cast("bigint"))
    spu = F.greatest(F.lit(1).cast("bigint"), B.floor_div(given, F.lit(SECTOR)))
    known = size.isNotNull() & (size != 0)

    def consistent(count: Column) -> Column:
        contradicts = F.coalesce(
            known & (count != B.expected_units(size, F.greatest(given, F.lit(1)))), F.lit(False)
        )
        return ~contradicts & ~(count * spu - B.range_count(ranges) > MAX_OVER_COVERAGE)

    misaligned = F.exists(ranges, lambda r: F.pmod(r["s"] - start, spu) != 0)
    keep = (given > 0) & ~misaligned & B.let(_unit_count(B.merge_ranges(ranges), start, spu), consistent)
    # -1 keeps the given size; inference runs only for the rows that need it
    found = F.when(keep, F.lit(-1)).otherwise(F.coalesce(infer_unit_size(ranges, start, size), F.lit(0)))
    return B.let(
        found,
        lambda v: F.struct(
            F.when(v == -1, given).when(v == 0, F.lit(SECTOR)).otherwise(v).cast("bigint").alias("unit_size"),
            F.when(v == -1, "fsstat").when(v == 0, "fallback_sector").otherwise("inferred").alias("source"),
        ),
    )


def print_mode(units: Column, size: Column, unit_size: Column) -> Column:
    """``fs`` if the unit count fits the file size, else ``sector``."""
    known = size.isNotNull() & (size != 0)
    fits = known & (B.range_count(units) == B.expected_units(size, unit_size))
    return F.when(F.coalesce(fits, F.lit(False)), "fs").otherwise("sector")
