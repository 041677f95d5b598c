"""Benchmark decontamination: windows of the test items in an Aho-Corasick automaton, one scan over each text.

The windows lie in the shared folder, in parts that one automaton can hold; a task reads the part it scans for, so none
pass through the driver. A benchmark of one part is found in one scan; each further part is a scan of its own, whose hits are
put together by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.llm.shared_files import opened
from exhume.llm.text_stats import fresh
from exhume.llm.worker import held
from exhume.session import Scratch

WINDOW = 10
#: (window, item) pairs of one automaton, so that a worker's memory is bounded (some 4 kB a window).
BLOCK = 50_000
#: Words are made of ASCII letters, digits and everything beyond ASCII; A-Z count as a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (window, item) pairs: every run of ``window`` words, or all words of an item with fewer.

    Items without words (null texts too) have none.
    """
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, SEPARATORS), lambda x: x != "")
    cut = items.select(F.col(item).cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))
    return cut.select(F.explode(windows).alias("window"), "item").distinct()


def write_parts(windows: DataFrame, scratch: Scratch, block: int) -> list[str]:
    """Folders of (window, item) pairs, about ``block`` in each; their number is all that reaches the driver."""
    listed = scratch.write(windows)
    parts = -(-listed.count() // block)
    if not parts:
        return []
    folder, number = scratch.path(), F.pmod(F.xxhash64("window", "item"), F.lit(parts)).cast("int")
    dealt = scratch.write(listed.withColumn("part", number))
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(folder)
    return [f"{folder}/part={r.part}" for r in dealt.select("part").distinct().orderBy("part").collect()]


class Automaton:
    """Windows as patterns with a space at both ends, in the bytes of UTF-8 (one character per byte)."""

    def __init__(self, pairs: list[tuple[str, str | None]]) -> None:
        self.found, self.items = ahocorasick.Automaton(), []
        known: dict[str, int] = {}
        for window, item in pairs:
            if window not in known:
                known[window] = len(self.items)
                self.items.append((window.count(" ") + 1, []))
            self.items[known[window]][1].append(item)
        for window, number in known.items():
            self.found.add_word(f" {window} ".encode().decode("latin-1"), number)
        if known:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(position of the space behind, window number) of all occurrences."""
        return list(self.found.iter(text)) if self.items else []


def read_part(path: str) -> Automaton:
    system, folder = opened(path)
    files = [f.path for f in system.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    table = pa.concat_tables([pyarrow.parquet.read_table(system.open_input_file(f)) for f in sorted(files)])
    return Automaton(list(zip(table["window"].to_pylist(), table["item"].to_pylist())))


def _automaton(path: str) -> Automaton:
    """A worker holds one automaton, for as long as its tasks scan for that part."""
    return held(("automaton", path), lambda: read_part(path))


def scan(data: bytes, automaton: Automaton | None) -> tuple[int, list[dict[str, int]], list[str]]:
    """Words, runs of hit words (places ``a`` to ``b``, and ``start`` to ``end`` in characters of the original), and the items with occurring windows."""
    folded = data.translate(_FOLDED)
    words = folded.split()
    if not words or automaton is None:
        return len(words), [], []
    text = b" ".join((b"", *words, b"")).decode("latin-1")
    hits: list[tuple[int, int]] = []
    names: set[str] = set()
    for end, number in automaton.matches(text):
        length, items = automaton.items[number]
        hits.append((end, length))
        names.update(i for i in items if i is not None)
    if not hits:
        return len(words), [], []
    # the space behind word k ends the match; k + 1 - length words before it the match begins
    behind = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(behind, np.array([h[0] for h in hits]))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, last + 1 - np.array([h[1] for h in hits]), 1)
    np.add.at(marks, last + 1, -1)
    hit = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    places = [m.span() for m in _WORD.finditer(folded)]
    chars = lambda at: len(data[:at].decode())
    runs = [{"a": a, "b": b, "start": chars(places[a][0]), "end": chars(places[b - 1][1])} for a, b in edges.reshape(-1, 2).tolist()]
    return len(words), runs, sorted(names)


_RUN = "struct<a: bigint, b: bigint, start: bigint, end: bigint>"
_FOUND = pa.struct([
    ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "start", "end")]))), ("items", pa.list_(pa.string())),
])


def _scanner(path: str | None) -> Column:
    @F.arrow_udf(f"struct<n_words: bigint, runs: array<{_RUN}>, items: array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        automaton = None if path is None else _automaton(path)
        made = (scan(value.as_py() or b"", automaton) for value in texts.cast(pa.binary()))
        return pa.array([{"n_words": n, "runs": runs, "items": names} for n, runs, names in made], _FOUND)

    return found


def joined_runs(runs: Column) -> Column:
    """Runs of several scans of one text as maximal runs, in order."""
    def step(done: Column, run: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], run["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        touches = F.coalesce(run["a"] <= last["b"], F.lit(False))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast(f"array<{_RUN}>"), step)


def _result(n_words: Column, runs: Column, items: Column) -> Column:
    hit = F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["b"] - r["a"])
    spans = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return F.struct(n_words.alias("n_words"), hit.alias("n_hit"), spans.alias("spans"), items.alias("items"))


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, result: str = "hits", block: int | None = None) -> DataFrame:
    """Every row of ``docs`` with the column ``result``: words, hit words, their spans in the original text, and item names sorted as strings.

    A null or empty text has no words; a row without item id marks words but
    names no item; with an empty benchmark nothing is hit; repeated rows are treated alike. With more than ``block`` (by default ``BLOCK``) windows ``docs`` are
    written once and scanned for each part.
    """
    scratch = Scratch(docs.sparkSession)
    parts = write_parts(item_windows(items, item, item_text, window), scratch, block or BLOCK)
    found, number = fresh(docs, "found", "number")
    first = _scanner(parts[0] if parts else None)(F.col(f"`{text}`"))
    if len(parts) < 2:
        judged = docs.withColumn(found, first)
        return judged.withColumn(result, _result(F.col(f"{found}.n_words"), F.col(f"{found}.runs"), F.col(f"{found}.items"))).drop(found)
    # written, so that a row has one number in all scans
    docs = scratch.write(docs.withColumn(number, F.monotonically_increasing_id()))
    texts = docs.select(F.col(f"`{text}`").alias("t"), F.col(number).alias("number"))
    rest = [texts.select("number", _scanner(p)(F.col("t")).alias("f")).filter(F.size("f.runs") > 0).select("number", "f.runs", "f.items") for p in parts[1:]]
    further = reduce(DataFrame.unionByName, rest).groupBy("number").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    further = scratch.write(further.select(F.col("number").alias(number), F.struct("runs", "items").alias(found)))
    judged = docs.join(further, number, "left")
    one, all_runs = fresh(judged, "one", "runs")
    judged = judged.withColumn(one, first)
    whole = joined_runs(F.concat(F.col(f"{one}.runs"), F.coalesce(F.col(f"{found}.runs"), F.array().cast(f"array<{_RUN}>"))))
    names = F.array_sort(F.array_distinct(F.concat(F.col(f"{one}.items"), F.coalesce(F.col(f"{found}.items"), F.array().cast("array<string>")))))
    return judged.withColumn(all_runs, whole).withColumn(result, _result(F.col(f"{one}.n_words"), F.col(all_runs), names)).drop(found, number, one, all_runs)


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` without any hit word, with their own columns only."""
    (name,) = fresh(docs, "hits")
    return find_contamination(docs, items, text, result=name).filter(F.col(f"{name}.n_hit") == 0).drop(name)
