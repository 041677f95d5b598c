"""Whole batches: every run has a score or a reason, carved files are scored from the files, and a job written twice stays one."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

import pytest

from exhume.plans.batch import score_batch
from exhume.session import shared_folder
from exhume.streaming.intake import read_summary, score_batches


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def bitmap(shade, side=40):
    rows = b"".join(bytes(((x * 6 + shade) % 256, (y * 5 * shade) % 256, 90)) for y in range(side) for x in range(side))
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    return head + (40).to_bytes(4, "little") + side.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + rows


def outcome(batch):
    scores = {(r.base_test_case, r.tool_used): (r.tp, r.fp, r.fn) for r in batch.results.collect()}
    return scores, sorted((r.base_test_case or "", r.tool_used or "", r.reason) for r in batch.rejected.collect())


def test_string_search_runs_of_one_case_and_tool_stay_apart(spark, tmp_path):
    row = lambda case, tool, cell, os="linux": {"base_test_case": case, "tool_used": tool, "os": os, "write_db": "0", "file_contents_found": cell}
    path = write_csv(tmp_path / "a.csv", [
        row("FT-1", "t", json.dumps(["x 0001 y", "x 0009"])), row("FT-1", "t", json.dumps(["0002"])), row("FT-1", "u", ""), row("FT-1", "v", "[1,"),
        row("", "v", "[]"), row("FT-9", "v", "[]"), row("FT-1", "w", "[]", "windows"),
    ])
    gt = spark.createDataFrame([("FT-1", "Linux", f"000{i}", "active", i) for i in (1, 2, 3)], "base_test_case string, os string, file_line string, type string, gt_pos long")
    batch = score_batch(spark, path, "string_search", gt)
    got = sorted((r.tool_used, r.tp, r.fp, r.fn) for r in batch.results.collect())
    assert got == [("t", 1, 0, 2), ("t", 1, 1, 2), ("u", 0, 0, 3)]
    assert outcome(batch)[1] == [("", "v", "missing base_test_case"), ("FT-1", "v", "invalid JSON in file_contents_found"), ("FT-1", "w", "no ground truth"), ("FT-9", "v", "no ground truth")]
    summary = batch.report().filter("is_summary").collect()
    assert len(summary) == 1 and summary[0].suite_score == pytest.approx(batch.results.agg({"f1": "avg"}).first()[0])
    for _ in range(2):
        batch.write(str(tmp_path / "out"), "string_search", "job 1")
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 3 and spark.read.json(str(tmp_path / "out/rejected")).count() == 4


def test_registry_listings_and_their_faults(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    write_csv(folder / "good one+.csv", [{"PATH": "HKLM\\a", "VALUE": "1"}, {"PATH": "HKLM\\b", "VALUE": "2"}])
    write_csv(folder / "odd.csv", [{"PATH": "HKLM\\a", "NOTE": "1"}])
    row = lambda case, file: {"base_test_case": case, "tool_used": "t", "submitted_csv_path": f"{folder}/{file}", "job_id": "0", "write_db": "0"}
    path = write_csv(tmp_path / "r.csv", [row("WR-1", "good one+.csv"), row("WR-2", "odd.csv"), row("WR-3", "none.csv"), row("WR-9", "good one+.csv")])
    gt = spark.createDataFrame([(f"WR-{i}", "HKLM\\a", v) for i in (1, 2, 3) for v in ("1", "3")], "base_test_case string, path string, value string")
    scores, rejected = outcome(score_batch(spark, path, "windows_registry", gt, str(folder)))
    assert scores == {("WR-1", "t"): (1, 1, 1)}
    assert rejected == [("WR-2", "t", "missing column VALUE"), ("WR-3", "t", "no file or no rows at submitted_csv_path"), ("WR-9", "t", "no ground truth")]


def test_sqlite_payloads(spark, tmp_path):
    row = lambda task, case, data: {"base_test_case": case, "tool_used": "t", "task_id": task, "file_name": "A.sqlite", "sqlite_table_name": "", "extracted_data_json": data}
    path = write_csv(tmp_path / "s.csv", [
        row("SFT01", "S-1", '{"page_size": 4096, "extra": "x"}'), row("SFT03", "S-2", '{"file_line": ["a", "zz"]}'), row("SFT03", "S-2", '{"file_line": "a"}'),
        row("SFT09", "S-1", "{}"), row("SFT01", "S-7", '{"a": "b"}'), row("SFT01", "S-1", ""), row("SFT01", "S-1", "{"),
    ])
    schema = "base_test_case string, file_name string, sqlite_table_name string, sqlite_cmd string, file_line string, gt_pos long, attributes map<string,string>"
    gt = spark.createDataFrame([("S-1", "a.sqlite", None, None, None, 1, {"page_size": "4096.0"}), ("S-2", "a.sqlite", None, None, "a", 2, None), ("S-2", "a.sqlite", None, None, "b", 3, None)], schema)
    batch = score_batch(spark, path, "sqlite_recovery", gt)
    assert sorted((r.base_test_case, r.tp, r.fp) for r in batch.results.collect()) == [("S-1", 2, 0), ("S-2", 1, 0), ("S-2", 1, 1)]
    assert [r[2] for r in outcome(batch)[1]] == ["invalid JSON in extracted_data_json", "missing extracted_data_json", "unknown task_id", "no ground truth"]


def test_deleted_files(spark, tmp_path):
    files = [{"file_name": "A.TXT", "file_size": "10", "blocks": "[5, 6]"}, {"file_name": "B.TXT", "file_size": "11", "blocks": "9-9"}]
    row = lambda tool, cell, test_set="NO_OVERWITE_TESTS": {
        "base_test_case": "DFR-01", "tool_used": tool, "file_system": "NTFS", "test_set": test_set, "sector_size": "512", "check_meta": "0", "write_db": "0", "files_json": cell,
    }
    path = write_csv(tmp_path / "d.csv", [row("t", json.dumps(files)), row("u", ""), row("v", json.dumps([files[0], files[0]])), row("w", "[]", "OTHER"), row("x", "no")])
    schema = "base_test_case string, file_name string, size long, modified_timestamp long, accessed_timestamp long, changed_timestamp long, dfr_blocks string, gt_pos long"
    gt = spark.createDataFrame([("dfr-01", "A.TXT", 10, None, None, None, "5-6", 1), ("dfr-01", "C.TXT", 12, None, None, None, "7", 2)], schema)
    scores, rejected = outcome(score_batch(spark, path, "deleted_file_recovery", gt))
    assert scores == {("DFR-01", "t"): (1, 1, 1), ("DFR-01", "u"): (0, 0, 2)}
    assert rejected == [("DFR-01", "v", "duplicate file_name"), ("DFR-01", "w", "invalid test_set"), ("DFR-01", "x", "invalid JSON in files_json")]


def test_carved_files_from_disk(spark, tmp_path):
    """Images are decoded, fingerprinted, set beside their nearest original and compared byte by byte."""
    tree = tmp_path / "files"
    for place, data in {"gt/a.bmp": bitmap(1), "gt/b.bmp": bitmap(9), "out/1.bmp": bitmap(1), "out/2.bmp": bitmap(9)[:3000], "out/3.bmp": bitmap(9)}.items():
        (tree / place).parent.mkdir(parents=True, exist_ok=True)
        (tree / place).write_bytes(data)
    row = lambda tool, files: {"base_test_case": "carv-1", "tool_used": tool, "write_db": "0", "files_json": json.dumps([f"{tree}/out/{f}" for f in files])}
    path = write_csv(tmp_path / "c.csv", [row("t", ["1.bmp", "2.bmp", "gone.bmp"]), row("u", ["1.bmp", "3.bmp"]), row("v", [])])
    gt = spark.createDataFrame([("carv-1", "a", 1, f"{tree}/gt/a.bmp"), ("carv-1", "b", 2, f"file:{tree}/gt/b.bmp")], "base_test_case string, gt_id string, gt_pos long, path string")
    scores, rejected = outcome(score_batch(spark, path, "file_carving", gt, str(tree)))
    assert scores == {("carv-1", "t"): (1, 2, 1), ("carv-1", "u"): (2, 0, 0)}
    assert rejected == [("carv-1", "v", "empty files_json")]


def test_one_stream_scores_every_suite_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The last file to arrive is a micro-batch of its own, which then runs again."""
    source, tree = tmp_path / "in", tmp_path / "files"
    for place, data in {"gt/a.bmp": bitmap(1), "out/1.bmp": bitmap(1), "out/2.bmp": bitmap(9)[:3000]}.items():
        (tree / place).parent.mkdir(parents=True, exist_ok=True)
        (tree / place).write_bytes(data)
    (tree / "lists").mkdir()
    write_csv(tree / "lists/l.csv", [{"PATH": "HKLM\\a", "VALUE": "1"}])
    search = lambda tool, lines: {"base_test_case": "FT-1", "tool_used": tool, "os": "linux", "write_db": "0", "file_contents_found": json.dumps(lines)}
    deleted = lambda tool, files: {
        "base_test_case": "DFR-01", "tool_used": tool, "file_system": "NTFS", "test_set": "NO_OVERWITE_TESTS", "sector_size": "512", "check_meta": "0", "write_db": "0",
        "files_json": json.dumps([{"file_name": n, "file_size": "10", "blocks": b} for n, b in files]),
    }
    arrivals = {
        "string_search/1 [a].csv": [search("t", ["x 0001"]), search("u", [])],
        "deleted_file_recovery/d.csv": [deleted("t", [("A.TXT", "[5, 6]"), ("B.TXT", "9-9")])],
        "deleted_file_recovery/e.csv": [deleted("u", [("A.TXT", "5-6")])],
        "windows_registry/r.csv": [{"base_test_case": "WR-1", "tool_used": "t", "submitted_csv_path": f"{tree}/lists/l.csv", "job_id": "0", "write_db": "0"}],
        "sqlite_recovery/s.csv": [{"base_test_case": "S-1", "tool_used": "t", "task_id": "SFT01", "file_name": "a.sqlite", "sqlite_table_name": "", "extracted_data_json": '{"page_size": 4096}'}],
        "file_carving/c.csv": [{"base_test_case": "carv-1", "tool_used": "t", "write_db": "0", "files_json": json.dumps([f"{tree}/out/1.bmp", f"{tree}/out/2.bmp"])}],
        "poetry/p.csv": [{"base_test_case": "P-1"}],
        "string_search/2.csv": [search("t", ["x 0001", "x 0002"]), search("", ["x"])],
    }
    for at, (place, rows) in enumerate(arrivals.items()):
        (source / place).parent.mkdir(parents=True, exist_ok=True)
        write_csv(source / place, rows)
        os.utime(source / place, (1e9 + at, 1e9 + at))
    gt = {
        "string_search": ([("FT-1", "linux", f"000{i}", "active", i) for i in (1, 2)], "base_test_case string, os string, file_line string, type string, gt_pos long"),
        "deleted_file_recovery": (
            [("DFR-01", "A.TXT", 10, None, None, None, "5-6", 1)],
            "base_test_case string, file_name string, size long, modified_timestamp long, accessed_timestamp long, changed_timestamp long, dfr_blocks string, gt_pos long",
        ),
        "windows_registry": ([("WR-1", "HKLM\\a", v) for v in ("1", "2")], "base_test_case string, path string, value string"),
        "sqlite_recovery": (
            [("S-1", "a.sqlite", None, None, None, 1, {"page_size": "4096"})],
            "base_test_case string, file_name string, sqlite_table_name string, sqlite_cmd string, file_line string, gt_pos long, attributes map<string,string>",
        ),
        "file_carving": ([("carv-1", "a", 1, f"{tree}/gt/a.bmp")], "base_test_case string, gt_id string, gt_pos long, path string"),
    }
    truth = lambda task: spark.createDataFrame(*gt[task])
    folders = {"windows_registry": str(tree / "lists"), "file_carving": str(tree)}
    out, mark = tmp_path / "out", tmp_path / "mark"

    def run():
        score_batches(spark, str(source), truth, str(out), str(mark), folders, len(arrivals) - 1, "test_case").awaitTermination()
        scores = sorted((r.task, r.test_case, r.TP, r.FP, r.FN) for r in spark.read.parquet(str(out / "results")).collect())
        rejected = sorted((r.task, r.reason) for r in spark.read.json(str(out / "rejected")).collect())
        summary = sorted((r.test_case, round(r.score, 6), r.total_submitted_files, r.SS) for r in read_summary(spark, str(out)).collect())
        return scores, rejected, summary

    first = run()
    assert first[0] == [
        ("deleted_file_recovery", "DFR-01_t", 1, 1, 0), ("deleted_file_recovery", "DFR-01_u", 1, 0, 0), ("file_carving", "carv-1_t", 1, 1, 0),
        ("sqlite_recovery", "S-1_t", 1, 0, 0), ("string_search", "FT-1_t", 1, 0, 1), ("string_search", "FT-1_t", 2, 0, 0), ("string_search", "FT-1_u", 0, 0, 2),
        ("windows_registry", "WR-1_t", 1, 0, 1),
    ]
    assert first[1] == [("string_search", "missing tool_used"), ("unknown", "no task named poetry")]
    # one row for each case and tool: FT-1_t came twice
    assert [r[0] for r in first[2]] == ["DFR-01_t", "DFR-01_u", "FT-1_t", "FT-1_u", "S-1_t", "WR-1_t", "carv-1_t"]
    assert [r[2] for r in first[2]] == [2, 1, 0, 0, 0, 0, 0]
    assert ("FT-1_t", 1.0, 0, 0) in first[2]
    assert sorted(int(p.name) for p in (mark / "commits").iterdir() if p.name.isdigit()) == [0, 1]
    for p in ("1", ".1.crc"):  # as if the last micro-batch had failed after its tables were written
        (mark / "commits" / p).unlink()
    assert run() == first
    # a file that arrives later replaces the summary of its case and tool only
    write_csv(source / "string_search/3.csv", [search("t", ["x 0009"])])
    later = run()
    assert len(later[0]) == 9
    assert [r for r in later[2] if r[0] != "FT-1_t"] == [r for r in first[2] if r[0] != "FT-1_t"] and ("FT-1_t", 0.0, 0, 0) in later[2]
    assert sorted(p.name for p in (out / "summary").iterdir()) == ["batch=1", "batch=2"]


def test_a_stream_of_stray_files_only(spark, tmp_path):
    (tmp_path / "in/none").mkdir(parents=True)
    write_csv(tmp_path / "in/none/a.csv", [{"a": "1"}])
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("*"))
    score_batches(spark, str(tmp_path / "in"), lambda task: None, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert read_summary(spark, str(tmp_path / "out")).count() == 0
    assert [r.reason for r in spark.read.json(str(tmp_path / "out/rejected")).collect()] == ["no task named none"]
    assert set(Path(shared_folder(spark).removeprefix("file:")).glob("*")) == before


def test_file_tree_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from exhume.checks import input_output
    from exhume.checks.fixtures import QUERIES

    rows = [(k, f"Supplier#{k}") for k in range(1, 41)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(input_output, "fresh", lambda spark, name: str(tmp_path / name))
    got = {(r.folder, r.size_bytes) for r in QUERIES["file_manifest"](spark, str(tmp_path)).collect()}
    assert got == {(f"s_suppkey={k}", len(name) + 1) for k, name in rows}
    files = list((tmp_path / "tree").glob("s_suppkey=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
