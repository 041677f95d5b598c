"""File-name identity (C6): two names are equal exactly when their keys are equal."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from exhume.functions.text import base_name

# Invisible and direction-control code points that do not count in a name.
INVISIBLE = (
    "\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2066\u2067\u2068\u2069\ufeff\u200b\u200c\u200d"
)

# Arabic-Indic digits (two blocks) and the dot look-alikes read as a full stop.
ARABIC_DIGITS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"
EXTENDED_ARABIC_DIGITS = "\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9"
DOT_LOOKALIKES = "\u06d4\u066b\u2024\uff0e\uff61\ufe52\u2219\u22c5\u00b7\u30fb"

# Code-point blocks that make a name Arabic.
ARABIC_CLASS = "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]"

_FROM = ARABIC_DIGITS + EXTENDED_ARABIC_DIGITS + DOT_LOOKALIKES + INVISIBLE
_TO = "0123456789" * 2 + "." * len(DOT_LOOKALIKES)  # translate() drops what has no partner


@F.pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Canonical composition; called with null for ASCII names."""
    return names.map(lambda n: unicodedata.normalize("NFC", n), na_action="ignore")


@F.pandas_udf(StringType())
def fold_case(names: pd.Series) -> pd.Series:
    """Full case folding (``lower`` keeps letters such as sharp s)."""
    return names.map(str.casefold, na_action="ignore")


def _non_ascii(c: Column) -> Column:
    return F.octet_length(c) != F.char_length(c)


def normalize_base_name(name: Column) -> Column:
    """Base name in NFC."""
    base = base_name(name)
    return F.coalesce(nfc(F.when(_non_ascii(base), base)), base)


def visible_name(name: Column) -> Column:
    """Base name in NFC, invisible characters gone, digits and dots in ASCII."""
    base = base_name(name)  # nothing changes in an ASCII name
    return F.when(_non_ascii(base), F.translate(normalize_base_name(name), _FROM, _TO)).otherwise(base)


def name_keys(visible: Column) -> tuple[Column, Column]:
    """(key on FAT, key elsewhere) of a visible name; the prefix keeps the branches apart.

    On FAT the first character is lost on deletion, so it is left out; an empty name has no key.
    """
    arabic = visible.rlike(ARABIC_CLASS)
    stem = F.concat(F.lit("A:"), F.regexp_replace(visible, r"(?:\.)?[tT][xX][tT][0-9]+$", ""))
    rest = F.substr(visible, F.lit(2))
    folded = F.coalesce(fold_case(F.when(_non_ascii(rest), rest)), F.lower(rest))
    fat = F.when(F.length(visible) > 0, F.concat(F.lit("F:"), folded))
    plain = F.concat(F.lit("N:"), visible)
    return F.when(arabic, stem).otherwise(fat), F.when(arabic, stem).otherwise(plain)


def is_fat(file_system: Column) -> Column:
    return F.coalesce(F.upper(file_system) == "FAT", F.lit(False))


def name_key(name: Column, file_system: Column) -> Column:
    fat, plain = name_keys(visible_name(name))
    return F.when(is_fat(file_system), fat).otherwise(plain)
