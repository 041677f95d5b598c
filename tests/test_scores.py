"""Score goldens and runs that must not be scored."""

from pyspark.sql import functions as F

from exhume.operators.raw_search import keyword_search_raw
from exhume.operators.reports import hit_blocks, parse_block_section
from exhume.operators.validate import dfr_reasons
from exhume.plans.dfr import dfr_score
from exhume.plans.sqlite import positional_compare, positional_score
from exhume.plans.string_search import string_search_score
from exhume.streaming.intake import score_payloads, score_stream


def test_string_search_golden(spark):
    """33 lines of which 6 are right, one id of 7 missed; the last of two types of a line wins."""
    truth = [("FT-1", "windows", f"{i:04d}", t, i) for i, t in enumerate(["active", "active", "active", "Deleted", "unalloc", "deleted", "deleted"])]
    truth += [("FT-1", "windows", " 0003", "deleted", 9), ("FT-1", "linux", "0099", "active", 10), ("FT-1", "windows", " ", "active", 11)]
    lines = [("ft-1 ", "Windows", "t", f"x {i:04d} y") for i in (0, 1, 2, 3, 4, 5)] + [("ft-1 ", "Windows", "t", f"n {i}") for i in range(5000, 5027)]
    sub = spark.createDataFrame(lines + [lines[0]], "base_test_case string, os string, tool_used string, line string")
    gt = spark.createDataFrame(truth, "base_test_case string, os string, file_line string, type string, gt_pos long")
    row = string_search_score(sub, gt).first()
    assert (row["tp"], row["fp"], row["fn"]) == (6, 27, 1)
    assert abs(row["f1"] - 0.3) < 1e-12
    assert (row["hits_active"], row["hits_deleted"], row["hits_unallocated"]) == (3, 2, 1)


def test_positional_counts_blank_twice(spark):
    sub = spark.createDataFrame([("r", 0, "5"), ("r", 1, "x"), ("r", 2, "y")], "run string, pos long, predicted string")
    gt = spark.createDataFrame([("r", 4, "5.0"), ("r", 8, "")], "run string, gt_pos long, file_line string")
    compared = positional_compare(sub, gt, ["run"])
    row = positional_score(compared, ["run"]).first()
    assert (row["tp"], row["fp"], row["fn"]) == (5, 0, -2)
    assert positional_score(compared, ["run"], compat=False).first()["tp"] == 3


FILES = "run string, base_test_case string, test_set string, file_system string, file_name string, file_size string, modified_timestamp string, accessed_timestamp string, changed_timestamp string, deleted_timestamp string, blocks string, sub_pos long"
TRUTH = "base_test_case string, file_name string, size long, modified_timestamp string, accessed_timestamp string, changed_timestamp string, dfr_blocks string, gt_pos long"


def dfr_row(run, test_set, name, size=None, blocks="", pos=0, times=(None, None, None)):
    return (run, "c", test_set, "FAT", name, size, *times, "0", blocks, pos)


def test_dfr_flags(spark):
    gt = spark.createDataFrame([("C", "A1.TXT", 512, "1", "2", "3", "1-4", 1), ("C", "B2.TXT", 1024, "4", "5", "6", "10, 11", 2)], TRUTH)
    rows = [
        dfr_row("full", "no_overwite_tests", "_1.TXT", "512", "1 2 3 4", 0), dfr_row("full", "no_overwite_tests", "ZZ", "7", "[10, 11]", 1), dfr_row("full", "no_overwite_tests", "ZZZ", "1024", "10-12", 2),
        dfr_row("mac", "MAC_TIME_TESTS", "q", None, "", 0, ("4", "5", "6")), dfr_row("mac", "MAC_TIME_TESTS", "r", None, "", 1, ("4", "5", "6")),
    ]
    runs = spark.createDataFrame([("full", "c", "NO_OVERWITE_TESTS"), ("mac", "c", "MAC_TIME_TESTS"), ("none", "C ", "RECYCLE_DEL_TESTS")], "run string, base_test_case string, test_set string")
    got = {r["run"]: r for r in dfr_score(spark.createDataFrame(rows, FILES), gt, ["run"], runs).collect()}
    full = got["full"]
    assert (full["tp"], full["fp"], full["fn"], full["ss"], full["full"], full["first"], full["match"]) == (2, 1, 0, 3, 2, 3, 1)
    assert (full["over"], full["multi"], full["size_match"]) == (1, 1, 2)
    assert (got["mac"]["tp"], got["mac"]["fp"], got["mac"]["fn"]) == (1, 1, 1)
    assert (got["none"]["tp"], got["none"]["fn"], got["none"]["rec"]) == (0, 2, 0)


def test_rejected_runs(spark):
    rows = [dfr_row("dup", "OVERWITE_TESTS", "a"), dfr_row("dup", "OVERWITE_TESTS", "a", pos=1), dfr_row("size", "FILE_SIZE_TESTS", "a", "NULL"), dfr_row("ok", "OVERWITE_TESTS", "a"), dfr_row("bad", "NON_LATIN_CHAR_TESTS", "a")]
    files = spark.createDataFrame(rows, FILES)
    runs = files.select("run", "base_test_case", "test_set", F.lit("t").alias("tool_used"), F.lit("1").alias("check_meta")).distinct()
    got = {r["run"]: r["reason"] for r in dfr_reasons(runs, files, ["run"]).collect()}
    assert got == {"dup": "duplicate file_name", "size": "missing file_size", "ok": None, "bad": "invalid test_set"}


def lines_of(spark, text):
    return spark.createDataFrame([("r", i, s) for i, s in enumerate(text.split("\n"))], "report string, line_no long, line string")


def test_block_section(spark):
    text = "Direct Blocks:\n 5 6 7\n9-11\n\n12\nType: $DATA (128-3) Non-Resident size: 9\n\n20 21\n\n30\nClusters: 40-42\nnote 99\nDeleted: 2024-01-01 00:00:00 (UTC)"
    row = parse_block_section(lines_of(spark, text), ["report"]).first()
    assert [(r["s"], r["e"]) for r in row["ranges"]] == [(5, 7), (9, 11), (20, 21), (40, 42)]
    assert row["deleted_timestamp"] == 1704067200


def test_hit_blocks(spark):
    text = "0001:kw:1:2:a.txt:apfs:utf-8\nHit [12]: Dire Wolf (n) (\nFile: /x/y\n00000000  41 42  |skipped|\ndd bs=512\n00000000  41 42  |one |\n00000010  41  |two|\nend\n00000020  41  |late|\n0002:kw:1:2:b.txt:apfs:utf-8\nHit [13]: k (\nnothing"
    got = sorted((r["line_no"], r["id"], r["keyword"], r["file"], r["file_line"]) for r in hit_blocks(lines_of(spark, text), ["report"]).collect())
    assert got == [(0, "Hit [0001]", "kw", "a.txt", ""), (1, "Hit [12]", "Dire Wolf", "/x/y", "onetwo"), (9, "Hit [0002]", "kw", "b.txt", ""), (10, "Hit [13]", "k", "", "")]


def test_raw_search_encodings(spark):
    data = b"..wolf.." + "Wolf".encode("utf-16le") + b"----" + "wolf".encode("utf-16be") + b"-w\0olf"
    df = spark.createDataFrame([(1, bytearray(data))], "id int, content binary")
    offsets = sorted(r["offset"] for r in keyword_search_raw(df, ["Wolf"], "id").collect())
    assert offsets == [2, 8, 20]
    assert [r["offset"] for r in keyword_search_raw(df, ["wolf"], "id", ignore_case=False).orderBy("offset").collect()] == [2, 20, 21, 29]


def test_stream_equals_batch(spark, tmp_path):
    payloads = [("FT-1", "windows", "a", ["x 0001", "0009"]), ("FT-1", "windows", "b", []), ("FT-2", "linux", "a", ["0002"]), ("FT-1", "windows", "", ["1"])]
    df = spark.createDataFrame(payloads, "base_test_case string, os string, tool_used string, file_contents_found array<string>")
    gt = spark.createDataFrame([("FT-1", "windows", "0001", "active", 1)], "base_test_case string, os string, file_line string, type string, gt_pos long")
    source, out, bad, mark = (str(tmp_path / n) for n in ("in", "out", "bad", "mark"))
    df.repartition(4).write.option("maxRecordsPerFile", 1).json(source)
    score_stream(spark, source, gt, out, bad, mark, files_per_batch=2).awaitTermination()
    scores, rejected = score_payloads(df, gt)
    streamed = sorted((r["test_case"], r["TP"], r["FP"], r["FN"]) for r in spark.read.parquet(out).collect())
    assert streamed == sorted((f"{r['base_test_case']}_{r['os']}_{r['tool_used']}", r["tp"], r["fp"], r["fn"]) for r in scores.collect())
    assert streamed == [("FT-1_windows_a", 1, 1, 0), ("FT-1_windows_b", 0, 0, 1)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["missing tool_used", "no ground truth"]
    assert spark.read.parquet(bad).count() == 2
