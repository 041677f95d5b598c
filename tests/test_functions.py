"""Scalar rules on hand-written edge rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from exhume.functions import blocks as B
from exhume.functions import names, text, times, values


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def spread(ranges):
    return sorted({n for r in ranges for n in range(r["s"], r["e"] + 1)})


@pytest.mark.parametrize("raw, expected", [
    ("12, 13, 14-16", [12, 13, 14, 15, 16]), ("[9-5]", [5, 6, 7, 8, 9]), ("12 - 15", [12, 15]), ("(0 4 0)", [4]),
    ("x, 7-, 8", [8]), ("", []), (None, []), ("3-3", [3]), ("0", []), ("0-2", [1, 2]), ("12 - 15, 3", [3, 12, 13, 14, 15]),
])
def test_block_lists(spark, raw, expected):
    got = one(spark, lambda v: B.block_set(B.token_ranges(B.parse_blocks(v))), raw)
    assert spread(got) == expected
    row = one(spark, B.block_summary, raw)
    assert row["set_size"] == len(expected)
    assert row["first_block"] == (expected[0] if expected else None)
    assert (row["block_key"] is None) == (not expected)


def test_merge_ranges_equals_set_union(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        spans = [(a, a + rng.randrange(6)) for a in (rng.randrange(60) for _ in range(rng.randrange(9)))]
        rows.append((i, [{"s": a, "e": b} for a, b in spans]))
    df = spark.createDataFrame(rows, f"i int, r {B.RANGE_TYPE}")
    for r in df.select("i", "r", B.merge_ranges(F.col("r")).alias("m")).collect():
        assert spread(r["m"]) == spread(r["r"])
        assert all(b["s"] > a["e"] + 1 for a, b in zip(r["m"], r["m"][1:]))


def test_huge_range_stays_one_interval(spark):
    row = one(spark, B.block_summary, "1-900000000000, 5")
    assert row["set_size"] == 900000000000 and row["block_key"] == "1-900000000000"


@pytest.mark.parametrize("raw, expected", [
    ("2012-02-03 15:10:01 (GMT)", dt.datetime(2012, 2, 3, 15, 10, 1)), ("2012-07-03 12:00:00 (EST)", dt.datetime(2012, 7, 3, 16)),
    ("Fri Feb 03 15:10:01 IST 2012", dt.datetime(2012, 2, 3, 9, 40, 1)), ("Fri Feb  3 15:10:01 2012", dt.datetime(2012, 2, 3, 15, 10, 1)),
    ("2011-10-09 13:10:20.660434905 -0400", dt.datetime(2011, 10, 9, 17, 10, 20)), ("2012-11-04 01:30:00 (EDT)", dt.datetime(2012, 11, 4, 6, 30)),
    ("2012-02-03 15:10:01 (XYZ)", dt.datetime(2012, 2, 3, 15, 10, 1)),
])
def test_epoch(spark, raw, expected):
    assert one(spark, times.to_epoch, raw) == int(expected.replace(tzinfo=dt.timezone.utc).timestamp())


def test_epoch_special(spark):
    assert one(spark, times.to_epoch, "0000-00-00 00:00:00 (UTC)") == 0
    assert one(spark, times.to_epoch, "yesterday") is None
    assert one(spark, times.to_epoch, "2012-02-30 00:00:00 (UTC)") is None


def test_epoch_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, times.to_epoch, "1970-01-02 00:00:00 (UTC)") == 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("a, b, fs, same", [
    ("_BEID.TXT", "dir/ABEID.txt", "FAT", True), ("_BEID.TXT", "ABEID.TXT", "NTFS", False), ("ملف.txt١", "ملف", "NTFS", True),
    ("é.txt", "é.txt", "EXT", True), ("xSTRASSE", "ystraße", "FAT", True), ("a‎b", "ab", "EXT", True), ("q", "z", "FAT", True),
    ("a·txt", "a.txt", "EXT", True),
])
def test_names(spark, a, b, fs, same):
    df = spark.createDataFrame([(a, b, fs)], "a string, b string, fs string")
    row = df.select(names.name_key(F.col("a"), F.col("fs")), names.name_key(F.col("b"), F.col("fs"))).first()
    assert (row[0] == row[1]) is same


def test_empty_fat_name_has_no_key(spark):
    assert spark.createDataFrame([("a/",)], "a string").select(names.name_key(F.col("a"), F.lit("FAT"))).first()[0] is None


@pytest.mark.parametrize("p, e, ok", [
    ("10", "10.0", True), ("nan", "nan", False), (None, "on", True), ("abcDef", "CD", True), ("x", " ", True), ("x", None, True),
    ("1_0", "10", True), ("inf", "Infinity", True), ("a", "1", False), ("10", "1", False),
])
def test_value_matches(spark, p, e, ok):
    df = spark.createDataFrame([(p, e)], "p string, e string")
    assert df.select(values.value_matches(F.col("p"), F.col("e"))).first()[0] is ok


def test_small_text_rules(spark):
    assert one(spark, text.line_id, "x 12345 0042 y") == "0042"
    assert one(spark, text.line_id, "none") is None
    assert one(spark, text.strip_dup_suffix, "file.txt1") == "file.txt"
    assert one(spark, text.derive_case, "image-contig-bmp.DD") == "carv-contig-bmp"
    assert one(spark, text.safe_file_name, "//") == "result"
    assert one(spark, text.to_int, " -7 ") == -7
    assert one(spark, text.to_int, "1.5") is None
    assert one(spark, text.extract_code, "```bash\nls\n``` ```python\nx\n```").asDict() == {"code": "x", "kind": "python"}
    assert one(spark, text.extract_code_labelled, "```\na\n``` ```sh\nls\n```")["kind"] in ("bash", "generic")
