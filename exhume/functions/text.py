"""Scalar text rules: line ids, type names, code blocks, case names, null and bool spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings the ground truth uses for the three deletion states.
UNALLOCATED_SPELLINGS = ("unalloc", "unalocated", "un-allocated")
LINE_TYPES = ("active", "deleted", "unallocated")

# Words read as true, and the suite names with their aliases.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
SUITES = (
    "string_search",
    "deleted_file_recovery",
    "file_carving",
    "windows_registry",
    "sqlite_recovery",
)
SUITE_ALIASES = {
    "dfr": "deleted_file_recovery",
    "wr": "windows_registry",
    "sqlite": "sqlite_recovery",
    "sqlite-recovery": "sqlite_recovery",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def case_key(c: Column) -> Column:
    """Join key for columns the ground-truth store compares case- and trailing-space-insensitively."""
    return F.lower(F.rtrim(c))


def line_id(text: Column) -> Column:
    """The first free-standing four-digit number; null when there is none.

    ``(?U)`` keeps word borders Unicode-aware on every Java version.
    """
    return blank_to_null(F.regexp_extract(text, r"(?U)\b([0-9]{4})\b", 1))


def norm_type(c: Column) -> Column:
    """Trimmed lower-case type with the spellings of ``unallocated`` folded together."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*UNALLOCATED_SPELLINGS), F.lit("unallocated")).otherwise(t)


def null_token(c: Column) -> Column:
    """``''`` and ``'NULL'`` stand for null."""
    return F.nullif(F.nullif(c, F.lit("")), F.lit("NULL"))


def parse_bool(c: Column, default: bool = False) -> Column:
    """C14: truthy words in any case; null gives the default, every other word is false."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(default))


def resolve_suite(c: Column) -> Column:
    """C14: suite name behind an alias, null when the name is unknown."""
    name = F.lower(F.trim(c))
    alias = F.create_map(*[F.lit(x) for kv in SUITE_ALIASES.items() for x in kv])
    name = F.coalesce(F.try_element_at(alias, name), name)
    return F.when(name.isin(*SUITES), name)


def to_int(c: Column) -> Column:
    """Integers as text; anything else (a float spelled as text, too) is null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


# Words that tell scripts apart, and the endings of prompts by script kind.
PYTHON_WORDS = ("def ", "import ", "class ")
BASH_WORDS = ("#!/bin/bash", "echo ", "sudo ", "apt-get ")
PYTHON_SCRIPT_WORDS = ("def ", "import ")
PROMPT_START = " You should provide a "
PROMPT_END = {"python": " code to achieve this task.  import ", "other": " code to achieve this task. #!/bin/bash"}


def _first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The word that comes first in the text; null if none does."""
    found = F.array(*[F.struct(F.nullif(F.instr(text, w), F.lit(0)).alias("at"), F.lit(w).alias("word")) for w in words])
    return F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))["word"]


def _fenced(text: Column, label: str) -> Column:
    # whether a block exists matters, not only its content: an empty block is a match too
    pattern = f"(?s)```{label}(.*?)```"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1), F.lit(" \t\n\r\f\v")))


def extract_code(text: Column) -> Column:
    """struct(code, kind) of the first python, else bash, else any fenced block."""
    python, bash, generic = _fenced(text, "python"), _fenced(text, "bash"), _fenced(text, "")
    return F.struct(
        F.coalesce(python, bash, generic, F.lit("")).alias("code"),
        F.when(python.isNotNull(), "python")
        .when(bash.isNotNull(), "bash")
        .when(generic.isNotNull(), "generic")
        .otherwise("")
        .alias("kind"),
    )


def extract_code_labelled(text: Column) -> Column:
    """C10, variant: blocks in order, first labelled one wins; then any block; then a keyword."""
    block = r"(?s)```(python|bash|sh)?(.*?)```"
    strip = F.lit(" \t\n\r\f\v")
    labels = F.regexp_extract_all(text, F.lit(block), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(block), F.lit(2))
    first = F.filter(
        F.arrays_zip(labels.alias("label"), bodies.alias("body")), lambda b: b["label"] != ""
    )
    hit = F.get(first, F.lit(0))
    python_word, bash_word = _first_word(text, PYTHON_WORDS), _first_word(text, BASH_WORDS)
    generic = _fenced(text, "")
    return F.struct(
        F.coalesce(
            F.trim(hit["body"], strip), generic, F.trim(python_word), F.trim(bash_word), F.lit("")
        ).alias("code"),
        F.when(hit["label"] == "python", "python")
        .when(hit["label"].isin("bash", "sh"), "bash")
        .when(generic.isNotNull(), "generic")
        .when(python_word.isNotNull(), "python")
        .when(bash_word.isNotNull(), "bash")
        .otherwise("")
        .alias("kind"),
    )


def classify_script(code: Column) -> Column:
    """C11: file kind of a script; null for blank code, which is skipped."""
    python = F.contains(code, F.lit("python")) | _first_word(code, PYTHON_SCRIPT_WORDS).isNotNull()
    return (
        F.when(F.trim(code, F.lit(" \t\n\r\f\v")) == "", F.lit(None).cast("string"))
        .when(F.contains(code, F.lit("bash")), "sh")
        .when(python, "py")
        .otherwise("txt")
    )


def render_prompt(template: Column, prompt: Column, path: Column, suffix: Column) -> Column:
    """C17: fill a prompt template and add the script-kind suffix."""
    filled = F.replace(template, F.lit("{prompt}"), prompt)
    return F.concat(F.replace(filled, F.lit("{DISK_IMAGE_PATH}"), path), suffix)


def script_suffix(script_type: Column) -> Column:
    """The fixed ending of a prompt for each script kind."""
    end = F.when(script_type == "python", PROMPT_END["python"]).otherwise(PROMPT_END["other"])
    return F.concat(F.lit(PROMPT_START), script_type, end)


def derive_case(image_name: Column) -> Column:
    """Test case behind an image name: no ``.dd``, ``image-`` becomes ``carv-``."""
    return F.regexp_replace(F.regexp_replace(image_name, r"(?i)\.dd$", ""), "^image-", "carv-")


def strip_dup_suffix(name: Column) -> Column:
    """``file.txt1`` -> ``file.txt`` on a base name."""
    return F.regexp_replace(name, r"^(.+?)(\.[^./\\\s]+?)[0-9]+$", "$1$2")


def base_name(name: Column) -> Column:
    return F.trim(F.substring_index(name, "/", -1), F.lit(" \t\n\r\f\v"))


def safe_file_name(name: Column) -> Column:
    """K2: only ``[A-Za-z0-9._-]``, runs of others become one ``_``; empty becomes ``result``."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]", "_")
    s = F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(blank_to_null(F.trim(s, F.lit("_"))), F.lit("result"))
