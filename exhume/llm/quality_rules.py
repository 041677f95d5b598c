"""Quality rules: a table of thresholds compiled into one projection over text counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.llm.text_stats import all_of, ratio, with_stats


class Rule(NamedTuple):
    """``top`` (over ``bottom``, if named) must lie within ``low`` and ``high``; it holds from ``from_words`` words on."""

    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("length", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop", "n_words", 0.02, None, 60),
    Rule("line_copies", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def holds(rule: Rule) -> Column:
    value = F.col(f"stats.{rule.top}") if rule.bottom is None else ratio(rule.top, rule.bottom)
    tests = ([value >= rule.low] if rule.low is not None else []) + ([value <= rule.high] if rule.high is not None else [])
    return (F.col("stats.n_words") < rule.from_words) | all_of(tests)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with ``stats``, ``base_failed``, the names of ``broken`` rules and ``kept``.

    One projection, no shuffle and no user function. A null or empty text has no words and so fails the
    base test; repeated rows are judged alike; columns named like the new ones are replaced.
    """
    counted = with_stats(docs, text)
    words, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (words < MIN_WORDS) | (repeated * 100 > words * MAX_REPEAT_PERCENT)
    broken = F.filter(F.array(*[F.when(~holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return (
        counted.withColumn("base_failed", failed).withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )
