"""Terms in lines of any length (J8, J14): one automaton for each bounded part of the terms, past which the lines stream once.

The terms are written to the shared folder in parts of about ``PART_LETTERS`` letters. A task scans its lines against one part, which it
reads from there itself; so a worker holds one automaton, built once, and no list of terms passes through the driver. Lines are
not shuffled, and a line costs its length for every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.session import Scratch

PART_LETTERS = 500_000
#: Letters that a term counts for besides its own.
OVERHEAD = 16


class TermPart:
    """The terms of one part: an automaton whose words lead to their rows, by the values of the keys."""

    def __init__(self, table: pa.Table, keys: int) -> None:
        self.table, self.found = table, ahocorasick.Automaton()
        words: dict[str, dict[tuple, list[int]]] = {}
        columns = [table.column(i).to_pylist() for i in range(1 + keys)]
        for row, (word, *own) in enumerate(zip(*columns)):
            words.setdefault(word, {}).setdefault(tuple(own), []).append(row)
        for word, rows in words.items():
            self.found.add_word(word, rows)
        if words:
            self.found.make_automaton()

    def rows(self, text: str, key: tuple) -> list[int]:
        """Rows of the terms with these key values that occur in the text, each once."""
        if not len(self.found):
            return []
        met = {id(rows): rows for _, rows in self.found.iter(text)}
        return sorted(row for rows in met.values() for row in rows.get(key, ()))


_HELD: dict[str, TermPart] = {}


def _part(path: str, keys: int) -> TermPart:
    """The part at ``path``; a worker holds one at a time."""
    if path not in _HELD:
        _HELD.clear()
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        files = [f.path for f in system.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        tables = [pyarrow.parquet.read_table(system.open_input_file(f)) for f in sorted(files)]
        _HELD[path] = TermPart(pa.concat_tables(tables), keys)
    return _HELD[path]


def _scan(batches: Iterator[pa.RecordBatch], path: str, keys: list[str], kept: list[str], added: list[str]) -> Iterator[pa.RecordBatch]:
    part = _part(path, len(keys))
    for batch in batches:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        lines, terms = [], []
        for i, text in enumerate(batch.column("_hay")):
            found = part.rows(text.as_py() or "", own[i])
            lines += [i] * len(found)
            terms += found
        for at in range(0, len(lines), 10_000):
            mine = batch.select(kept).take(pa.array(lines[at : at + 10_000], pa.int64()))
            theirs = part.table.select([f"o{i}" for i in range(len(added))]).take(pa.array(terms[at : at + 10_000], pa.int64())).combine_chunks()
            columns = [*mine.columns, *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in theirs.columns)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])


def find_terms(lines: DataFrame, terms: DataFrame, text: str, term: str, keys: list[str] | None = None, part_letters: int = PART_LETTERS) -> DataFrame:
    """Rows of ``lines`` (without ``text``) with each distinct row of ``terms`` (without ``term`` and keys) whose term occurs in the text, and whose ``keys`` are equal.

    A pair comes once, however often the term occurs. Empty and null terms, null texts and null keys match nothing. ``terms`` are
    written to the shared folder, which pyarrow has to open.
    """
    keys, scratch = keys or [], Scratch(lines.sparkSession)
    added = [c for c in terms.columns if c not in (*keys, term)]
    known = terms.filter(F.length(term) > 0).dropna(subset=keys) if keys else terms.filter(F.length(term) > 0)
    named = [F.col(f"`{term}`").alias("w"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(added)]]
    listed = scratch.write(known.select(*named).distinct())
    # one number reaches the driver, whatever the number of terms
    letters = listed.agg(F.sum(F.length("w") + OVERHEAD)).first()[0] or 0
    parts = max(1, -(-letters // part_letters))
    dealt = listed.withColumn("part", F.pmod(F.xxhash64(*listed.columns), F.lit(parts)).cast("int"))
    folder = scratch.path()
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(folder)
    kept = [c for c in lines.columns if c != text]
    kinds = [lines.schema[c] for c in kept] + [terms.schema[c] for c in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    streamed = lines.withColumnRenamed(text, "_hay")
    present = [r.part for r in dealt.select("part").distinct().collect()]

    def scanned(part: int) -> DataFrame:
        path = f"{folder}/part={part}"
        return streamed.mapInArrow(lambda batches: _scan(batches, path, keys, kept, added), schema)

    if not present:
        return streamed.select(*kept, *[F.lit(None).cast(terms.schema[c].dataType).alias(c) for c in added]).filter("false")
    return reduce(DataFrame.unionByName, map(scanned, sorted(present)))
