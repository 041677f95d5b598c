"""Language identification by cross-parsing: phrases of longest matches in a suffix automaton per language."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exhume.llm.text_stats import fresh, hash_below
from exhume.session import Scratch

UNKNOWN = "und"
#: What is learned from: so many excerpts per language, of so many letters each; at most so many bytes of all languages.
EXCERPTS, EXCERPT_CHARS, TOTAL_BYTES, LANGUAGE_BYTES = 96, 300, 240_000, 24_000
#: A text is parsed in blocks of so many bytes side by side; each block begins a new phrase.
BLOCK = 512
#: Bytes and rows of texts that are parsed at once.
AT_ONCE, ROWS_AT_ONCE = 2 << 20, 500


def normalised(text: Column) -> Column:
    """Lower-case letters, other runs one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model(NamedTuple):
    """``table[state + symbol]``: twice the next state, plus 1 where a phrase begins; ``symbol[byte]``; a start state per language."""

    languages: tuple[str, ...]
    table: np.ndarray
    symbol: np.ndarray
    starts: np.ndarray
    weights: np.ndarray


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``data`` (online construction; state 0 is the start)."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for byte in data:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at >= 0:
            target = moves[at][byte]
            if longest[at] + 1 == longest[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(byte) == target:
                    moves[at][byte] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


def build(samples: dict[str, bytes]) -> Model:
    """Automata of all languages in one table, each of its own sample; what short samples leave of ``TOTAL_BYTES`` goes to the others."""
    languages = tuple(sorted(x for x, data in samples.items() if data))
    if not languages:
        return Model((), np.zeros(0, np.int32), np.zeros(256, np.int32), np.zeros(0, np.int32), np.zeros(0))
    used, room = {}, TOTAL_BYTES
    for nth, x in enumerate(sorted(languages, key=lambda x: len(samples[x]))):
        used[x] = samples[x][: min(LANGUAGE_BYTES, max(room // (len(languages) - nth), 1))]
        room -= len(used[x])
    seen = sorted(set(b"".join(used.values())))
    width = len(seen) + 1  # the last symbol stands for every byte that no language has
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    tables, starts, base = [], [], 0
    for language in languages:
        moves = suffix_automaton(used[language])
        root = np.full(width, 2 * base + 1, np.int64)
        for byte, to in moves[0].items():
            root[symbol[byte]] = 2 * (base + to * width) + 1
        # where a state has no move, the byte begins a phrase, as every byte at the start does
        table = np.tile(root, (len(moves), 1))
        for state, out in enumerate(moves[1:], 1):
            for byte, to in out.items():
                table[state, symbol[byte]] = 2 * (base + to * width)
        tables.append(table.ravel())
        starts.append(base)
        base += len(moves) * width
    # a phrase costs its place in the sample, and never less than a byte spelt out
    weights = np.array([max(math.log2(len(used[x])), 8.0) for x in languages])
    return Model(languages, np.concatenate(tables).astype(np.int32), symbol, np.array(starts, np.int32), weights)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model from a bounded sample: per language the excerpts of least hash, cut at a place that the hash names.

    Rows without language or letters teach nothing; copies teach once. Few hashes of each language are looked at, as
    many at any size, so a language with most of the rows is no burden.
    """
    clean = labelled.select(F.col(lang).alias("lang"), normalised(F.col(text)).alias("t")).filter(F.col("lang").isNotNull() & has_letters(F.col("t")))
    hashed = clean.withColumn("h", F.xxhash64("t"))
    place = F.pmod(F.col("h"), F.greatest(F.length("t") - EXCERPT_CHARS, F.lit(0)) + 1).cast("int") + 1
    # texts are read once; what is counted and picked afterwards are excerpts
    scratch = Scratch(labelled.sparkSession)
    excerpts = scratch.write(hashed.select("lang", "h", F.substring(F.col("t"), place, F.lit(EXCERPT_CHARS)).alias("t")))
    counts = {r.lang: r.n for r in excerpts.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        scratch.drop(excerpts)
        return build({})
    # of each language only hashes that can be among its least
    bounds = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, hash_below(EXCERPTS, n))])
    cut = excerpts.filter(F.col("h") <= F.element_at(bounds, F.col("lang"))).groupBy("lang", "h").agg(F.min("t").alias("t"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = cut.withColumn("nth", nth).filter(F.col("nth") <= EXCERPTS).collect()
    scratch.drop(excerpts)
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.nth)):
        samples.setdefault(r.lang, []).append(r.t)
    return build({x: " ".join(dict.fromkeys(texts)).encode() for x, texts in samples.items()})


def phrases(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases per text (rows) and language of the texts ``data[bounds[i]:bounds[i + 1]]``.

    All blocks of all texts take one step at a time, longest blocks first, so that the running ones stay in front.
    """
    sizes = np.diff(bounds)
    pieces = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[:-1][owner] + nth * BLOCK
    length = np.minimum(BLOCK, bounds[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    symbols = model.symbol[data]
    state = np.repeat(model.starts[:, None], len(begin), 1)
    begun = np.zeros(state.shape, np.int32)
    running = len(length) - np.searchsorted(length[::-1], np.arange(1, BLOCK + 1))
    for step in range(int(length[0]) if len(length) else 0):
        n = running[step]
        move = model.table[state[:, :n] + symbols[begin[:n] + step]]
        begun[:, :n] += move & 1
        state[:, :n] = move >> 1
    total = np.zeros((len(sizes), len(model.languages)))
    for k in range(len(model.languages)):
        total[:, k] = np.bincount(owner[order], weights=begun[k], minlength=len(sizes))
    return total


def judge(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of normalised texts; the score is how much fewer phrases the best has than the next."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return langs, scores
    texts = texts.cast(pa.large_string())
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(first, first[at] + AT_ONCE, "right")) - 1)
        bounds = first[at : to + 1] - first[at]
        counted = phrases(model, whole[first[at] : first[to]], bounds)
        size = np.diff(bounds)
        cost = counted * model.weights / np.maximum(size, 1)[:, None]
        best = cost.argmin(1)
        for i in np.flatnonzero(size).tolist():
            own = cost[i]
            langs[at + i] = model.languages[best[i]]
            others = np.delete(own, best[i])
            scores[at + i] = round(float(1 - own[best[i]] / others.min()), 6) if len(others) else 1.0
        at = to
    return langs, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. With equal counts the
    first language in order of names wins. The model's size is bounded by ``TOTAL_BYTES``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def parse(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), ROWS_AT_ONCE):  # what is made along the way stays small
            more = judge(held.value, texts.slice(at, ROWS_AT_ONCE).fill_null(""))
            langs += more[0]
            scores += more[1]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    column = F.col(f"`{text}`")
    (name,) = fresh(docs, "parsed")
    # without letters the text is taken as empty
    parsed = docs.withColumn(name, parse(F.when(has_letters(column), normalised(column))))
    return parsed.withColumn("lang_pred", F.col(f"{name}.lang")).withColumn("score", F.col(f"{name}.score")).drop(name)
