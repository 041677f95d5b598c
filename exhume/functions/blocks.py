"""Block and sector lists, kept as sorted disjoint intervals.

A block list such as ``12-14, 90`` is never expanded: a range of a billion blocks stays one
``struct<s,e>``. Set equality, size and minimum are all read off the canonical interval list, and the
per-row work is O(k log k) in the number of ranges with built-in array functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE_TYPE = "array<struct<s:bigint,e:bigint>>"


def _range(s: Column, e: Column) -> Column:
    return F.struct(s.alias("s"), e.alias("e"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(text: Column) -> Column:
    """Digits as bigint; the empty string goes around the cast, which would raise inside."""
    return F.nullif(text, F.lit("")).try_cast("bigint")


def no_ranges() -> Column:
    return F.array().cast(RANGE_TYPE)


def merge_ranges(ranges: Column) -> Column:
    """Sorted disjoint non-adjacent intervals covering the same integers.

    With starts and ends sorted independently, a gap follows the i-th interval exactly where
    ``start[i+1] > end[i] + 1``; no running fold is needed.
    """
    def cut(starts: Column, ends: Column) -> Column:
        n = F.size(starts)
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        gaps = F.filter(steps, lambda i: F.get(starts, i) > F.get(ends, i - 1) + 1)
        return let(
            gaps,
            lambda at: F.zip_with(
                F.concat(F.slice(starts, 1, 1), F.transform(at, lambda i: F.get(starts, i))),
                F.concat(F.transform(at, lambda i: F.get(ends, i - 1)), F.slice(ends, -1, 1)),
                _range,
            ),
        )

    def several(rs: Column) -> Column:
        return let(
            F.array_sort(F.transform(rs, lambda r: r["s"])),
            lambda starts: let(
                F.array_sort(F.transform(rs, lambda r: r["e"])), lambda ends: cut(starts, ends)
            ),
        )

    return let(ranges, lambda rs: F.when(F.size(rs) < 2, rs).otherwise(several(rs)))


def range_count(ranges: Column) -> Column:
    """How many integers a list of ranges spans, counting overlaps twice."""
    return F.aggregate(
        ranges, F.lit(0).cast("bigint"), lambda acc, r: acc + r["e"] - r["s"] + 1
    )


def format_ranges(ranges: Column, sep: str = ",") -> Column:
    """``1-3,7,9-10`` from canonical ranges."""
    return F.array_join(
        F.transform(
            ranges,
            lambda r: F.when(r["s"] == r["e"], r["s"].cast("string")).otherwise(
                F.concat_ws("-", r["s"].cast("string"), r["e"].cast("string"))
            ),
        ),
        sep,
    )


def parse_blocks(text: Column) -> Column:
    """Non-empty trimmed tokens of a block list given as text (JSON arrays included)."""
    def tokens(t: Column) -> Column:
        bracketed = t.rlike(r"(?s)^(\[.*\]|\(.*\))$")
        inside = F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
        return let(
            F.when(bracketed, inside).otherwise(t),
            lambda s: F.when(F.contains(s, F.lit(",")), F.split(s, ",")).otherwise(F.split(s, r"\s+")),
        )

    space = F.lit(" \t\n\r\f\v\"")
    parts = let(F.trim(F.coalesce(text, F.lit("")), space), tokens)
    return F.filter(F.transform(parts, lambda p: F.trim(p, space)), lambda p: p != "")


def token_ranges(tokens: Column) -> Column:
    """``a-b`` (either direction) and plain numbers as ranges; other tokens are dropped."""
    pattern = r"^\s*([0-9]+)(?:\s*-\s*([0-9]+))?\s*$"

    def one(t: Column) -> Column:
        # bound step by step, as no expression is shared within a lambda; the second is empty for a single number
        texts = F.struct(F.regexp_extract(t, pattern, 1).alias("a"), F.regexp_extract(t, pattern, 2).alias("b"))
        numbers = let(texts, lambda x: F.struct(digits(x["a"]).alias("a"), digits(x["b"]).alias("b")))
        return let(numbers, lambda x: _range(F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"])))  # both skip nulls

    return F.filter(F.transform(tokens, one), lambda r: r["s"].isNotNull())


def token_count(ranges: Column) -> Column:
    """How many block numbers the expanded token list holds, block 0 and repeats included."""
    return range_count(ranges)


def block_set(ranges: Column) -> Column:
    """C4: canonical ranges of the distinct non-zero blocks."""
    positive = F.filter(ranges, lambda r: r["e"] > 0)
    clipped = F.transform(positive, lambda r: _range(F.greatest(r["s"], F.lit(1)), r["e"]))
    return merge_ranges(clipped)


def first_block(canonical: Column) -> Column:
    """C4: the smallest block of a canonical set, null when it is empty."""
    return F.get(canonical, F.lit(0))["s"]


def block_key(canonical: Column) -> Column:
    """Text equal for equal block sets and null for the empty set."""
    return F.nullif(format_ranges(canonical), F.lit(""))


def block_summary(text: Column) -> Column:
    """struct(set_size, block_key, first_block, has_tokens) of a block list, parsed once.

    A lone number or range, the usual case, is answered by plain expressions; only longer lists
    enter the array functions. A generator shares no expressions, so the numbers are bound before they are used.
    """
    pattern = r"^\s*[0-9]{1,18}(?:-[0-9]{1,18})?\s*\z"
    # both are the whole text of a lone number; the cast passes over white space
    numbers = F.struct(*[F.substring_index(text, "-", i).try_cast("bigint").alias(n) for i, n in ((1, "a"), (-1, "b"))])

    def summary(size: Column, key: Column, first: Column, tokens: Column) -> Column:
        return F.struct(
            size.alias("set_size"), key.alias("block_key"), first.alias("first_block"), tokens.alias("has_tokens")
        )

    nothing = F.lit(None)
    def lone(low: Column, high: Column) -> Column:
        return F.when(high == 0, summary(F.lit(0).cast("bigint"), nothing.cast("string"), nothing.cast("bigint"), F.lit(True))).otherwise(
            summary(
                high - low + 1,
                F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))),
                low, F.lit(True),
            )
        )

    single = let(numbers, lambda x: lone(F.greatest(F.least(x["a"], x["b"]), F.lit(1)), F.greatest(x["a"], x["b"])))
    listed = let(
        token_ranges(parse_blocks(text)),
        lambda rs: let(
            block_set(rs), lambda m: summary(range_count(m), block_key(m), first_block(m), F.size(rs) > 0)
        ),
    )
    empty = summary(F.lit(0).cast("bigint"), nothing.cast("string"), nothing.cast("bigint"), F.lit(False))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", empty).when(text.rlike(pattern), single).otherwise(listed)


def compute_once(df, column: Column):
    """Add the fields of a struct column as columns, evaluated in one place.

    A generator keeps later filters from being pushed below it, which would repeat the work.
    """
    return df.select("*", F.inline(F.array(column)))


def _pairs(text: Column) -> tuple[Column, Column]:
    pattern = F.lit(r"([0-9]+)\s*-\s*([0-9]+)")
    lows = F.regexp_extract_all(text, pattern, F.lit(1))
    highs = F.regexp_extract_all(text, pattern, F.lit(2))
    return lows, highs


def parse_ranges(text: Column) -> Column:
    """Sorted distinct ranges of ``S-E`` pairs plus single numbers outside every pair.

    A single number can only lie inside a pair if it lies inside the merged pairs, so the text is
    searched once and no pair list is scanned per number beyond the merged one.
    """
    t = F.coalesce(text, F.lit(""))
    lows, highs = _pairs(t)
    pairs = F.zip_with(
        F.transform(lows, lambda x: x.try_cast("bigint")),
        F.transform(highs, lambda x: x.try_cast("bigint")),
        lambda a, b: _range(F.least(a, b), F.greatest(a, b)),
    )

    def with_singles(ps: Column) -> Column:
        return let(
            merge_ranges(ps),
            lambda cover: F.concat(
                ps,
                F.transform(
                    F.filter(
                        _numbers(t),
                        lambda n: ~F.exists(cover, lambda r: (r["s"] <= n) & (n <= r["e"])),
                    ),
                    lambda n: _range(n, n),
                ),
            ),
        )

    return F.array_sort(F.array_distinct(let(pairs, with_singles)))


def _numbers(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([0-9]+)\b"), F.lit(1)))
    return F.transform(found, lambda n: n.try_cast("bigint"))


def parse_ranges_endpoints(text: Column) -> Column:
    """C8, variant: a number is dropped only when it equals an endpoint; null on a reversed pair."""
    t = F.coalesce(text, F.lit(""))
    lows, highs = _pairs(t)
    pairs = F.zip_with(
        F.transform(lows, lambda x: x.try_cast("bigint")),
        F.transform(highs, lambda x: x.try_cast("bigint")),
        _range,
    )

    def with_singles(ps: Column) -> Column:
        ends = F.concat(F.transform(ps, lambda r: r["s"]), F.transform(ps, lambda r: r["e"]))
        singles = F.transform(F.array_except(_numbers(t), ends), lambda n: _range(n, n))
        backwards = F.exists(ps, lambda r: r["e"] < r["s"])
        return F.when(~backwards, F.array_sort(F.array_distinct(F.concat(ps, singles))))

    return let(pairs, with_singles)


def floor_div(a: Column, b: Column) -> Column:
    """Integer division towards minus infinity."""
    r = F.pmod(a, b)
    return F.call_function("div", a - r, b)


def sectors_to_units(ranges: Column, start: Column, sectors_per_unit: Column) -> Column:
    """Canonical ranges of the units touched by absolute sector ranges."""
    return merge_ranges(
        F.transform(
            ranges,
            lambda r: _range(
                floor_div(r["s"] - start, sectors_per_unit), floor_div(r["e"] - start, sectors_per_unit)
            ),
        )
    )


def relative_sectors(ranges: Column, start: Column) -> Column:
    """Canonical ranges of the sectors counted from the partition start."""
    return merge_ranges(F.transform(ranges, lambda r: _range(r["s"] - start, r["e"] - start)))


def fat_data_start(
    start: Column, reserved: Column, fats: Column, fat_len: Column, root_entries: Column, sector: Column
) -> Column:
    """C20: first sector of a FAT data area; a missing root directory entry count means FAT32."""
    root = F.coalesce(floor_div(root_entries * 32 + sector - 1, sector), F.lit(0).cast("bigint"))
    return start + reserved + fats * fat_len + root


def fat_clusters(units: Column, data_start: Column, start: Column, spu: Column) -> Column:
    """C20: cluster numbers, counted from 2 at the data area, for unit ranges."""
    shift = F.lit(2) - floor_div(data_start - start, spu)
    return F.transform(units, lambda r: _range(r["s"] + shift, r["e"] + shift))


def expected_units(size: Column, unit: Column) -> Column:
    """ceil(size / unit), 0 for unknown or non-positive sizes."""
    known = F.coalesce(size, F.lit(0).cast("bigint"))
    return F.when(known <= 0, F.lit(0).cast("bigint")).otherwise(floor_div(known + unit - 1, unit))
