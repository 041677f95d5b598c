"""SimHash near-duplicates: Golay codes turn nearby fingerprint segments into equal keys.

A fingerprint has three segments, each a word of the perfect binary Golay code of length 23 with its upper bits zero. Every
such word lies within three bits of exactly one codeword. Two words at most one bit apart either have one nearest codeword,
or each lies four bits from the other's; so the nearest codeword of one is always among the keys of the other: its
own nearest codeword and, if that is three bits away, the (at most five) codewords four bits away.

With three wrong bits or fewer, either one segment is equal and another has one error at most, or all three have exactly one.
Both cases give keys of over 32 bits, some 64 for each distinct fingerprint. Fingerprints that share a key
are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.llm.sorted_groups import bounds, in_cells, whole_groups
from exhume.operators.components import components
from exhume.operators.lookup import lookup_join
from exhume.session import Scratch

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LENGTH, CHECK = 23, 11
#: Generator of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = sum(1 << power for power in (11, 10, 6, 5, 4, 2, 0))
#: Fingerprints of one block; a cell compares two blocks. Groups up to SMALL are compared side by side.
BLOCK, SMALL = 2048, 48


def _remainder(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator: zero for codewords, and different for any two errors of three bits or fewer."""
    left = words.astype(np.int64)
    for power in range(LENGTH - 1, CHECK - 1, -1):
        left = np.where(left >> power & 1, left ^ (GENERATOR << power - CHECK), left)
    return left


def _errors() -> np.ndarray:
    """The error of at most three bits behind every remainder."""
    single = [1 << b for b in range(LENGTH)]
    patterns = np.array([sum(c) for n in range(DISTANCE + 1) for c in combinations(single, n)], np.int64)
    table = np.zeros(1 << CHECK, np.int64)
    table[_remainder(patterns)] = patterns
    return table


_ERROR = _errors()
_FLIP = _remainder(1 << np.arange(LENGTH, dtype=np.int64))


def nearest(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword within three bits of each word."""
    return (words ^ _ERROR[_remainder(words)]) >> CHECK


def fuzzy_keys(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """(n, 6) numbers of the codewords nearest to each word and to all words one bit away; repeated where there are fewer.

    Only the ``width`` lower bits are ever wrong.
    """
    left = _remainder(words)
    around = [(words ^ _ERROR[left]) >> CHECK]
    for bit in range(width):
        flipped = words ^ (1 << bit)
        around.append((flipped ^ _ERROR[left ^ _FLIP[bit]]) >> CHECK)
    near = np.sort(np.stack(around, 1), 1)
    new = np.concatenate((np.zeros((len(words), 1), bool), near[:, 1:] != near[:, :-1]), 1)
    keys = np.repeat(near[:, :1], 6, 1)
    row, column = np.nonzero(new)
    keys[row, np.cumsum(new, 1)[row, column]] = near[row, column]
    return keys


def join_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``fingerprints``, keys): any two fingerprints three bits or fewer apart have a key in common."""
    parts = [(fingerprints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    fuzzy = [fuzzy_keys(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    sure = [nearest(p)[:, None] for p in parts]
    # one segment equal, another with one error at most
    made = [kind << 40 | parts[i][:, None] << 12 | fuzzy[j] for kind, (i, j) in enumerate(permutations(range(len(SEGMENTS)), 2))]
    # one error in each: the one has keys for two segments, the other for the third
    triple = lambda a, b, c: (6 << 40 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]).reshape(len(a), -1)
    made += [triple(fuzzy[0], fuzzy[1], sure[2]), triple(sure[0], sure[1], fuzzy[2])]
    keys = np.sort(np.concatenate(made, 1), 1)
    new = np.concatenate((np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]), 1)
    return np.nonzero(new)[0], keys[new]


def fingerprint(text: bytes) -> int:
    """SimHash of a text over its three-word shingles, repeats included; 0 without words.

    A bit is set if over half the shingle hashes have it. A-Z count as a-z, white space of ASCII parts words; fewer words than three are one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = starts[SHINGLE:] or starts[-1:]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        # sums of up to 255 rows fit a byte
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        for low in range(0, len(bits), 255):
            count += bits[low : low + 255].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; ``fp`` is the fingerprint as a signed number. A null text counts as one without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column("t").cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).mapInArrow(sign, f"key {kind}, fp bigint")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("fp").to_numpy()
        place, keys = join_keys(own.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(own[place]), pa.array(keys)], ["fp", "k"])


def _least_reached(least: np.ndarray, own: np.ndarray, cross: bool) -> None:
    """Lower every label to the least fingerprint reachable by links within one cell."""
    values, n = least.copy().view(np.uint64), len(least)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        linked[at : at + 256] = np.bitwise_count(values[at : at + 256, None] ^ values[None, :]) <= DISTANCE
    if cross:
        linked &= own[:, None] != own[None, :]
    while True:
        before = least.copy()
        for at in range(0, n, 256):
            reached = np.where(linked[at : at + 256], least[None, :], np.iinfo(np.int64).max).min(1)
            least[at : at + 256] = np.minimum(least[at : at + 256], reached)
        if (least == before).all():
            return


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of whole cells: each fingerprint with the least one that links of its cell reach."""
    for table in whole_groups(batches, "cell"):
        edge = bounds(table["cell"])
        fp, own, cross = (table[c].to_numpy() for c in ("fp", "own", "cross"))
        fp, size = fp.copy(), np.diff(edge)
        least = fp.copy()
        for at in np.flatnonzero(size > SMALL):
            a, b = edge[at], edge[at + 1]
            _least_reached(least[a:b], own[a:b], bool(cross[a]))
        # small cells side by side: each member with the next one, the one behind that, and so on
        behind = np.repeat(edge[1:], size) - np.arange(len(fp)) - 1
        behind[np.repeat(size > SMALL, size)] = 0
        links = []
        for step in range(1, SMALL):
            at = np.flatnonzero(behind >= step)
            if not len(at):
                break
            near = np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= DISTANCE
            near &= ~cross[at] | (own[at] != own[at + step])
            links.append(np.stack((at[near], at[near] + step)))
        u, v = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
        while True:
            before = least.copy()
            np.minimum.at(least, u, least[v])
            np.minimum.at(least, v, least[u])
            if (least == before).all():
                break
        some = np.flatnonzero(least != fp)
        yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(least[some])], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp``: links that connect whatever lies three bits or fewer apart.

    Not every close pair is a row: a cell returns a spanning star, so a large group costs comparisons and not rows.
    """
    keyed = distinct.select("fp").mapInArrow(_keyed, "fp bigint, k bigint")
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    cells = in_cells(keyed.join(shared.hint("merge"), "k"), "n", "fp", BLOCK)
    cells = cells.select(F.xxhash64("k", "a", "b").alias("cell"), "fp", "own", (F.col("a") != F.col("b")).alias("cross"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component) of every row of ``docs``.

    Rows are linked if their fingerprints differ in three bits or fewer; ``component`` is the least key that links reach, the row's own
    included. Texts without words (null, empty) have fingerprint 0 and are linked like any other. Repeated rows are linked with each
    other; a component whose keys are all null has none. An empty table gives an empty one. Other columns of ``docs`` are not
    read. The result reads staged tables.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(fingerprints(docs, text, key))
    distinct = scratch.write(signed.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("rows")))
    joined = components(links(distinct), scratch)
    placed = scratch.write(
        distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("group"))
    )
    firsts = placed.groupBy("group").agg(F.min("least").alias("component"))
    named = scratch.write(placed.join(firsts, "group").select("fp", "rows", "component"))
    return lookup_join(signed, named, ["fp"], "rows").select("key", "fp", "component")
