"""Keyword search in raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from exhume.functions.blocks import let
from exhume.sources.chunks import read_chunks

CHUNK = 1 << 20
# Encodings a hit's surroundings are shown in, the first that gives visible text.
SHOWN_AS = ("utf-8", "utf-16le", "utf-16be")


def cut_chunks(blobs: DataFrame, key: str, content: str, before: int, behind: int, size: int = CHUNK) -> DataFrame:
    """(key, at, lead, bytes): chunks of ``size`` bytes with ``before`` and ``behind`` bytes around them; ``lead`` of them come before."""
    starts = F.sequence(F.lit(0), F.octet_length(content) - 1, F.lit(size))

    def piece(data: Column, at: Column) -> Column:
        lead = F.least(at, F.lit(before))
        return F.struct(at.cast("bigint").alias("at"), lead.alias("lead"), F.substring(data, at - lead + 1, lead + size + behind).alias("bytes"))

    # bound once, as every look at the column would copy the whole blob
    pieces = let(F.col(content), lambda data: F.transform(starts, lambda at: piece(data, at)))
    return blobs.filter(F.octet_length(content) > 0).select(F.col(key).alias("key"), F.inline(pieces))


class _Finder:
    """All keywords at once: one automaton per view of the bytes."""

    def __init__(self, terms: list[str], ignore_case: bool) -> None:
        self.fold = ignore_case
        plain, wide, spaced = {}, {}, {}
        for number, term in enumerate(terms):
            data = term.encode("utf-8", "ignore")
            plain.setdefault(data.lower() if ignore_case else data, set()).add(number)
            for spelling in {term, term.lower()} if ignore_case else {term}:
                for codec in ("utf-16le", "utf-16be"):
                    wide.setdefault(spelling.encode(codec, "ignore"), set()).add(number)
            if term.isascii():
                spaced.setdefault(data, set()).add(number)
        self.plain, self.wide, self.spaced = map(self._automaton, (plain, wide, spaced))

    @staticmethod
    def _automaton(words: dict[bytes, set[int]]) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for word, numbers in words.items():
            if word:
                found.add_word(word.decode("latin-1"), (len(word), tuple(numbers)))
        if not len(found):
            return None
        found.make_automaton()
        return found

    @staticmethod
    def _starts(found: ahocorasick.Automaton | None, data: bytes) -> Iterator[tuple[int, int]]:
        for end, (length, numbers) in found.iter(data.decode("latin-1")) if found else ():
            for number in numbers:
                yield end + 1 - length, number

    def places(self, data: bytes) -> set[tuple[int, int]]:
        """(start, term number) of every place where a term starts in any spelling."""
        # a zero byte behind another byte is passed over: letters may be one zero apart
        values = np.frombuffer(data, np.uint8)
        kept = np.flatnonzero((values != 0) | (np.concatenate(([0], values[:-1])) == 0))
        return {
            *self._starts(self.plain, data.lower() if self.fold else data), *self._starts(self.wide, data),
            *((int(kept[at]), number) for at, number in self._starts(self.spaced, values[kept].tobytes())),
        }


def search_chunks(chunks: DataFrame, terms: list[str], ignore_case: bool = True, size: int = CHUNK, context: int = 64) -> DataFrame:
    """(key, term, offset, around, lead) of the places in chunks of ``cut_chunks``; ``around`` has the bytes next to a place."""
    terms = sorted({t for t in terms if t})
    names = ["key", "term", "offset", "around"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(terms, ignore_case)
        for batch in batches:
            for i, (at, lead, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "lead", "bytes")))):
                own = sorted((s, n) for s, n in finder.places(piece) if lead <= s < lead + size)
                for first in range(0, len(own), 10_000):
                    part = own[first : first + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("key").take(pa.array([i] * len(part))), pa.array([terms[n] for _, n in part], pa.string()),
                        pa.array([at + s - lead for s, _ in part], pa.int64()), pa.array([piece[max(0, s - context) : s + context] for s, _ in part], pa.binary()),
                    ], names)

    kind = chunks.schema["key"].dataType.simpleString()
    return chunks.mapInArrow(search, f"key {kind}, term string, offset bigint, around binary")


@F.arrow_udf(StringType())
def shown(around: pa.Array) -> pa.Array:
    """Bytes as one line of visible text, or in hex where no encoding gives any."""
    return pa.array([next((t.translate({10: " ", 13: " "}) for c in SHOWN_AS if (t := b.decode(c, "ignore")).strip()), b.hex()) for b in around.to_pylist()], pa.string())


def keyword_search_raw(
    blobs: DataFrame, terms: list[str], key: str, content: str = "content", ignore_case: bool = True, context: int = 64
) -> DataFrame:
    """(key, term, offset, snippet) for every place a keyword starts in the bytes, overlapping ones included.

    A keyword is met as UTF-8, as UTF-16 in either byte order, or with a zero byte behind any of its letters. The
    keywords are the caller's argument. Blobs are searched in chunks that overlap by the longest
    spelling; snippets are made in a second step, from the bytes around the hits alone.
    """
    longest = 4 * max((len(t) for t in terms), default=1)
    chunks = cut_chunks(blobs, key, content, context, max(longest, context))
    found = search_chunks(chunks, terms, ignore_case, context=context)
    return found.select(F.col("key").alias(key), "term", "offset", shown("around").alias("snippet"))


def keyword_search_files(
    spark: SparkSession, folder: str, terms: list[str], ignore_case: bool = True, context: int = 64, size: int = CHUNK
) -> DataFrame:
    """(path, term, offset, snippet) over all files below ``folder``, which are read in chunks and may have any size."""
    longest = 4 * max((len(t) for t in terms), default=1)
    chunks = read_chunks(spark, folder, size, before=context, behind=max(longest, context)).withColumnRenamed("path", "key")
    found = search_chunks(chunks.filter("own > 0").select("key", "at", "lead", "bytes"), terms, ignore_case, size, context)
    return found.select(F.col("key").alias("path"), "term", "offset", shown("around").alias("snippet"))
