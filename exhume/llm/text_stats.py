"""Counts over whole texts as plain Spark expressions (no user functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.blocks import let

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the supported languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "be", "by", "this", "are", "from", "at", "an",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "im", "zu", "nicht", "ein", "eine", "sich", "auf", "für", "des", "dem", "als",
    "le", "la", "les", "des", "et", "de", "du", "un", "une", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "pas", "il",
    "el", "los", "las", "y", "del", "que", "se", "por", "con", "no", "su", "para", "es", "al", "lo", "como", "más", "una",
)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := f"_{x}{i}").lower() not in taken) for x in names]


def hash_below(wanted: int, rows: int) -> int:
    """Bound below which so many of ``rows`` 64-bit hashes are to be expected, with room to spare.

    Picks the rows of least hash without every task handing in its own candidates, which would grow with the tasks.
    """
    share = min(1.0, (2 * wanted + 200) / max(rows, 1))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, none, step, lambda acc: acc["n"])

    def shared(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        )
        return covered(F.sort_array(F.transform(let(ordered, twice), lambda x: x["i"])))

    windows = F.size(words) - WINDOW + 1
    # every word is hashed once; a window is the hash of five neighbouring word hashes
    names = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.arrays_zip(*[F.slice(h, k + 1, windows) for k in range(WINDOW)]))
    hashed = F.transform(names, lambda x: F.xxhash64(x))
    count = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), shared(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= WINDOW, count).otherwise(F.lit(0))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``stats`` of counts over the whole text; a null text counts as empty.

    Words are runs without ASCII white space. ``n_dup_lines`` counts lines with a word that equal an
    earlier line, ``n_repeat_words`` the words in 5-word windows found twice or more.
    """
    words, lines, whole = fresh(docs, "words", "lines", "text")
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # words and lines are columns of their own, so that no expression cuts the text again
    cut = docs.withColumn(whole, full).withColumn(words, F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    cut = cut.withColumn(lines, F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, t = F.col(words), F.col(whole)
    stop = list(dict.fromkeys(STOP_WORDS))
    n = lambda c: c.cast("bigint")
    # what is left out is mostly little, so cutting it out costs less than collecting matches
    chars = lambda kind: F.length(t) - F.length(F.regexp_replace(t, kind, ""))
    stats = F.struct(
        n(F.size(w)).alias("n_words"),
        n(F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x))).alias("word_chars"),
        n(chars(SYMBOLS)).alias("n_symbols"),
        n(F.size(lines)).alias("n_lines"),
        n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        n(_repeated_words(w)).alias("n_repeat_words"),
        n(F.size(F.filter(w, lambda x: F.lower(x).isin(stop)))).alias("n_stop"),
        n(F.size(F.array_distinct(w))).alias("n_distinct"),
        n(chars(r"\p{Lu}")).alias("n_upper"),
        n(chars(r"[!?;:,.]")).alias("n_marks"),
    )
    return cut.withColumn("stats", stats).drop(words, lines, whole)


def ratio(top: str, bottom: str) -> Column:
    """Quotient of two counts of ``stats``; 0 where there is nothing to divide by."""
    return F.when(F.col(f"stats.{bottom}") > 0, F.col(f"stats.{top}") / F.col(f"stats.{bottom}")).otherwise(F.lit(0.0))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))
