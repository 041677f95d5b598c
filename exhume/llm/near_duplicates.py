"""N-gram Jaccard join: MinHash bands find candidates, full sets of five-word shingles decide.

Texts with equal shingle sets are one node. Buckets of equal bands give star edges (never all pairs); nodes they connect
are compared in cells of bounded size, cut by component and by set size, and each cell returns sums and a spanning
star per node. So a large group costs comparisons, but no rows beyond its members and cells.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.operators.components import components
from exhume.llm.text_stats import fresh
from exhume.llm.worker import held
from exhume.session import Scratch

SHINGLE, THRESHOLD = 5, 0.8
#: Hashes per band, and the share of pairs at the threshold that must meet in some band.
ROWS, RECALL = 6, 0.99999
#: Nodes of one block; a cell compares two blocks.
BLOCK = 256
#: Size classes are this much wider than 1 / threshold, beyond which sizes cannot differ; room for rounding.
SIZE_ROOM = 1.04
CACHED = 250_000


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes that miss a pair at the threshold with a probability of 1 - ``recall`` at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_ODD = np.random.default_rng(7).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words (white space of ASCII parts words).

    A text of fewer words is one shingle; one without words has none.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        hashed = np.concatenate([hashed, np.full(SHINGLE - len(words), len(words), np.uint64)])
    n = len(hashed) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += hashed[k : k + n] * _ODD[k]
    return np.unique(_mixed(total))


class _Signer:
    """Band hashes of shingle sets."""

    def __init__(self, count: int, rows: int) -> None:
        draw = np.random.default_rng(11)
        self.count, self.rows = count, rows
        self.factor = draw.integers(0, 1 << 63, count * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, count * rows, np.uint64) * np.uint64(2)
        self.weight = draw.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = draw.integers(0, 1 << 63, count, np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), 1024):
            table = values[at : at + 1024, None] * self.factor
            table += self.shift
            np.minimum(least, table.min(0), out=least)
        return _mixed((least.reshape(self.count, self.rows) * self.weight).sum(1) + self.band).view(np.int64)


def signatures(docs: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """(key, th, hi, lo, n, bands) of every row: hash of the text, 128-bit name and size of the shingle set, band hashes.

    ``hi`` and ``lo`` are null for texts without words.
    """
    count = bands(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(count, ROWS)
        for batch in batches:
            hi, lo, sizes, banded, known = [], [], [], [], {}
            for value in batch.column("t").cast(pa.binary()):
                own = shingles(value.as_py() or b"")
                sizes.append(len(own))
                if not len(own):
                    hi.append(None), lo.append(None), banded.append(None)
                    continue
                name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if name not in known:
                    known[name] = signer(own)
                hi.append(int.from_bytes(name[:8], "little", signed=True))
                lo.append(int.from_bytes(name[8:], "little", signed=True))
                banded.append(known[name])
            columns = [batch.column("key"), batch.column("th"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sizes, pa.int64()), pa.array(banded, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "th", "hi", "lo", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(text).alias("th"), F.col(f"`{text}`").alias("t")).mapInArrow(
        sign, f"key {kind}, th bigint, hi bigint, lo bigint, n bigint, bands array<bigint>"
    )


def candidate_edges(signed: DataFrame) -> DataFrame:
    """Star edges (u, v) of all buckets: each member with the bucket's least."""
    members = signed.filter("hi is not null").select("hi", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("hi").alias("v"), F.max("hi").alias("last")).filter("v <> last")
    return members.join(buckets.select("band", "v").hint("merge"), "band").filter("hi <> v").select(F.col("hi").alias("u"), "v").distinct()


def _cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows (cell columns, side, node) of all comparisons that can reach the threshold.

    A pair meets in the cell group of its component and lesser size class, where the larger class has role 1; a large
    group is cut into blocks, and each pair of blocks is one cell.
    """
    classed = nodes.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_ROOM / threshold)).cast("int"))
    placed = classed.withColumn("at", F.explode(F.array(F.struct(F.col("k").alias("k"), F.lit(0).alias("role")), F.struct((F.col("k") - 1).alias("k"), F.lit(1).alias("role")))))
    placed = placed.select("component", F.col("at.k").alias("k"), F.col("at.role").alias("role"), "hi", "lo", "n", "copies", "key", "th")
    groups = placed.groupBy("component", "k").agg(F.count("*").alias("size"), F.min("role").alias("least")).filter("least = 0 and size > 1")
    met = placed.join(groups.select("component", "k", "size"), ["component", "k"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("component", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "role", "hi", "lo", "copies", "key", "th")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the shingles that two sets or more have, some thousand at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[number] > 1
    column = np.cumsum(count > 1) - 1
    owner, number = owner[shared], column[number[shared]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    total, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        low, high = np.searchsorted(number, [at, at + width])
        table = np.zeros((len(sets), min(width, int(number[-1]) + 1 - at)), np.float32)
        table[owner[low:high], number[low:high] - at] = 1
        total += table @ table.T
    return total


def compare_cell(cell: pa.Table, threshold: float) -> pa.Table:
    """Per node of a cell: copies behind its links found here, and an edge to the least node it is linked with here."""
    a, b = cell["a"][0].as_py(), cell["b"][0].as_py()
    own, role, hi, copies = (cell[c].to_numpy() for c in ("own", "role", "hi", "copies"))
    sets = [shingles(t.as_py() or b"") for t in cell["t"].cast(pa.binary())]
    size = np.array([len(s) for s in sets], float)
    both = _overlaps(sets)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    # each pair counts in one cell: across the two blocks (or within the one), and never between two of role 1
    linked &= (role[:, None] + role[None, :] < 2) & ((own[:, None] != own[None, :]) if a != b else True)
    np.fill_diagonal(linked, False)
    links = (linked * copies[None, :]).sum(1)
    least = hi.copy()
    while True:  # least node reachable within the cell
        reached = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (reached == least).all():
            break
        least = reached
    some = np.flatnonzero(links)
    return pa.table({"hi": hi[some], "lo": cell["lo"].to_numpy()[some], "links": links[some].astype(np.int64), "least": least[some]})


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, th, class_id, n_links, class) of every row of ``docs``.

    ``n_links`` counts the other rows whose shingle set has a Jaccard similarity of ``threshold`` or more with the row's own (copies
    included); rows connected by links are one class, named by its least key (``class`` is a number of its own, null without words). ``th`` is the text's hash. A text without words
    (null, empty) is alone: its own key and no links. Repeated rows are copies of each other; null keys never name a
    class that has another key. Other columns of ``docs`` are not read. The result reads staged tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    signed = scratch.write(signatures(docs, text, key, threshold))
    candidates = scratch.write(components(candidate_edges(signed), scratch))
    texts = signed.filter("hi is not null").groupBy("hi", "lo").agg(F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "th")).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies"))
    texts = scratch.write(texts.select("hi", "lo", "n", "copies", "first.key", "first.th"))
    nodes = texts.join(candidates, texts["hi"] == candidates["node"]).drop("node")
    cells = scratch.write(_cells(nodes, threshold))
    bodies = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(text).alias("th"), F.col(f"`{text}`").alias("t"))
    # one plan at every size: texts meet their cells by a sort-merge join
    wanted = cells.select("key", "th").distinct().hint("merge")
    same = bodies["key"].eqNullSafe(wanted["key"]) & (bodies["th"] == wanted["th"])
    bodies = bodies.join(wanted, same, "left_semi").dropDuplicates(["key", "th"])
    whole = cells.join(bodies, cells["key"].eqNullSafe(bodies["key"]) & (cells["th"] == bodies["th"])).select("component", "k", "a", "b", "own", "role", "hi", "lo", "copies", "t")
    compared = whole.groupBy("component", "k", "a", "b").applyInArrow(lambda cell: compare_cell(cell, threshold), "hi bigint, lo bigint, links bigint, least bigint")
    found = scratch.write(compared)
    classes = components(found.select(F.col("hi").alias("u"), F.col("least").alias("v")), scratch)
    linked = found.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    named = texts.join(linked, ["hi", "lo"], "left").join(classes, F.col("hi") == F.col("node"), "left")
    named = scratch.write(named.select("hi", "lo", "key", F.coalesce("component", "hi").alias("class"), F.col("component").isNotNull().alias("joined"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # a class of one text has that text's first key; only classes of several need the least of all
    least = named.filter("joined").groupBy("class").agg(F.min("key").alias("least"))
    named = named.join(least, "class", "left").select("hi", "lo", "n_links", "class", F.when(F.col("joined"), F.col("least")).otherwise(F.col("key")).alias("class_id"))
    rows = signed.select("key", "th", "hi", "lo").join(named, ["hi", "lo"], "left")
    return rows.select(
        "key", "th", F.when(F.col("hi").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "class",
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the row of least key of every class, and all rows without words; columns as they were."""
    kept_key, kept_hash = fresh(docs, "kept_key", "kept_hash")
    judged = near_duplicates(docs, text, key, threshold)
    least = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "th")).alias("least")
    first = judged.filter("class is not null").groupBy("class").agg(least).select(F.col("least.key").alias(kept_key), F.col("least.th").alias(kept_hash))
    worded = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    mine = F.col(f"`{key}`").eqNullSafe(F.col(kept_key)) & (F.xxhash64(text) == F.col(kept_hash))
    kept = docs.filter(worded).join(first, mine).dropDuplicates([kept_key, kept_hash]).drop(kept_key, kept_hash)
    return kept.unionByName(docs.filter(~worded))
