"""Steps whose cost grew faster than their input: results beside plain Python, and what the cost hangs on."""

import random
import re
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from exhume.functions import blocks as B
from exhume.functions.names import visible_name
from exhume.operators import assign, contains, sectors
from exhume.operators.assign import assign_unique
from exhume.operators.ground_truth import cases_with_prefix, gt_prefix
from exhume.operators.ordered import carry_all, merge_intervals, rank_in_group
from exhume.plans.sqlite import sqlite_score
from exhume.session import Scratch
from exhume.sinks.results import write_reports


def test_bucketed_passes_join_nothing_back(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), p, random.choice([None, None, (p or 0) * 2])) for p in [None, *random.sample(range(300), 200)]]
    df = spark.createDataFrame(rows, "g string, p bigint, v bigint")
    ranked = rank_in_group(df, ["g"], "p", "rn", width=16)
    carried = carry_all(df, ["g"], "p", {"last": F.col("v")}, {"most": "v"}, width=16)
    for made in (ranked, carried):
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g in ("a", "b", None):
        last = most = None
        for n, (_, p, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)), 1):
            last = v if v is not None else last
            want[g, p] = (n, last, most)
            most = max((x for x in (most, v) if x is not None), default=None)
    assert {(r.g, r.p): r.rn for r in ranked.collect()} == {k: w[0] for k, w in want.items()}
    assert {(r.g, r.p): (r["last"], r.most) for r in carried.collect()} == {k: w[1:] for k, w in want.items()}


def test_merged_intervals_over_buckets(spark):
    random.seed(4)
    rows = [(random.choice(["a", None]), s, s + random.randint(1, 30)) for s in random.choices(range(2000), k=150)]
    got = {(r.g, r.lo, r.hi) for r in merge_intervals(spark.createDataFrame(rows, "g string, s bigint, e bigint"), ["g"], "s", "e", width=64).collect()}
    want = set()
    for g in ("a", None):
        cells = sorted({x for k, s, e in rows if k == g for x in range(s, e)})
        runs = [i for i, x in enumerate(cells) if not i or cells[i - 1] != x - 1] + [len(cells)]
        want |= {(g, cells[i], cells[j - 1] + 1) for i, j in zip(runs, runs[1:])}
    assert got == want


def test_unit_sizes_by_kernel_and_by_expressions(spark):
    random.seed(5)
    rows = []
    for i in range(400):
        ranges = [(s, s + random.choice([0, 1, 7, 15, 63, 100])) for s in (random.randint(0, 400) * 8 + random.choice([0, 63]) for _ in range(i % 6))]
        ranges = None if i % 51 == 1 else [(None, 5), *ranges] if i % 97 == 2 else [(90, 70), *ranges] if i % 89 == 3 else ranges
        rows.append((ranges, random.choice([63, 0, 2048, None]), random.choice([None, 0, 512, 4096, 9000, -4])))
    df = spark.createDataFrame(rows, "r array<struct<s:bigint,e:bigint>>, at bigint, size bigint")
    for hint in (False, True):
        args = (F.col("r"), F.col("at"), F.col("size"), hint)
        both = df.select(sectors.infer_unit_size(*args).alias("a"), sectors._infer_row(*args).alias("b")).collect()
        assert [x.a for x in both] == [x.b for x in both]


def test_long_tokens_are_met_by_long_pieces(spark, monkeypatch):
    names = [f"f{i:06d}-{i % 3}.txt" for i in range(0, 3000, 7)]
    tokens = [*{n[2:] for n in names[::3]}, "7-1", "2-0.t", "abcdefghi"]
    staged = []
    monkeypatch.setattr(contains, "stage", lambda df: staged.append(df) or df)
    found = contains.containment_join(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in tokens], "token string"), "name", "token")
    assert {(r.name, r.token) for r in found.collect()} == {(n, t) for n in names for t in tokens if t in n}
    assert all(len(r._gram) == 8 for r in staged[0].filter("length(token) >= 8").collect())


def test_submissions_are_prepared_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def prepare(key):
        seen.add(1)
        return key

    raw = spark.createDataFrame([("r", i, str(i % 4)) for i in range(40)], "run string, sub_pos bigint, raw string")
    sub = raw.withColumn("key", F.udf(prepare, StringType())("raw"))
    gt = spark.createDataFrame([(str(i % 5), f"f{i}", i) for i in range(30)], "key string, file_name string, gt_pos bigint")
    got = {(r.sub_pos): r.mapped for r in assign_unique(sub, gt, ["run"], []).collect()}
    assert got == {i: f"f{5 * (i // 4) + i % 4}" if i // 4 < 6 else None for i in range(40)}
    assert seen.value == 40


def test_block_texts_are_searched_once(spark):
    texts = [None, "", " ", "7", " 7-3 ", "0", "0-0", "0-5", "12\n", "12-\n13", "4, 2", "[1, 2-9, 3]", "(x) 5", "1234567890123456789", "9 - 4", "-3", "5\u2028"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    made = B.compute_once(df, B.block_summary(F.col("t")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # one test of the lone form; two searches for each token of a list
    assert plan.count("RLIKE") <= 2 and plan.count("regexp_extract(") <= 2
    got = {r.i: (r.set_size, r.block_key, r.first_block, r.has_tokens) for r in made.collect()}
    none = (0, None, None, False)
    want = [none, none, none, (1, "7", 7, True), (5, "3-7", 3, True), (0, None, None, True), (0, None, None, True), (5, "1-5", 1, True), (1, "12", 12, True)]
    want += [(1, "13", 13, True), (2, "2,4", 2, True), (9, "1-9", 1, True), (1, "5", 5, True), (1234567890123456789 - 1234567890123456789 + 1, "1234567890123456789", 1234567890123456789, True)]
    want += [(2, "4,9", 4, True), none, (1, "5", 5, True)]
    assert got == dict(enumerate(want))


def test_ascii_names_skip_the_table_of_letters(spark):
    df = spark.createDataFrame([("a/b.TXT ",), ("x/e\u0301\u200e\u0661.txt",), (None,)], "n string")
    made = df.select(visible_name(F.col("n")).alias("v"))
    assert [r.v for r in made.collect()] == ["b.TXT", "\u00e91.txt", None]
    assert "CASE WHEN" in made._jdf.queryExecution().analyzed().toString().split("translate(")[0]


def test_rounds_send_no_tables_to_the_driver(spark):
    ranked = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 1, 2)], "run string, key string, _rn bigint, sub_pos bigint")
    free = spark.createDataFrame([("r", "a", "f", 1), ("r", "b", "f", 2), ("r", "b", "g", 3)], "run string, key string, file_name string, gt_pos bigint")
    stop = assign._undisturbed(ranked, free, ["run"], ["run", "key"])
    assert "Broadcast" not in stop._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in stop.collect()] == [("r", "b", 1)]


def test_runs_are_not_copied_for_each_case_of_their_prefix(spark):
    gt = spark.createDataFrame([(f"D-{i}", f"f{i % 3}", i) for i in range(40)] + [("E", "f1", 99)], "base_test_case string, file_name string, gt_pos int")
    runs = spark.createDataFrame([("d-1", "F1"), ("D-", "f2"), ("D", "f9"), ("x", "f1"), (None, "f1")], "base_test_case string, file_name string")
    found = gt_prefix(gt, runs, ["gt_pos"])
    assert re.search(r"Join Inner, \(+asked#\d+ = asked#\d+\) AND \(_file#\d+ = _file#\d+\)", found._jdf.queryExecution().analyzed().toString())
    got = sorted((r.base_test_case, r.file_name, r.gt_pos) for r in found.collect())
    names = [(f"d-{i}", f"f{i % 3}", i) for i in range(40)]
    want = [(a, f, i) for a, f in (("d-1", "F1"), ("D-", "f2"), ("D", "f9")) for c, g, i in names if c.startswith(a.lower()) and g == f.lower()]
    assert got == sorted(want) and len(got) > 10


def test_reports_score_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def scored(case):
        seen.add(1)
        return case

    numbers = ["rec", "tp", "fp", "fn", "ss", "first", "full", "match", "over", "multi", "size_match"]
    rows = spark.range(5).select(F.udf(scored, StringType())(F.col("id").cast("string")).alias("base_test_case"), *[F.lit("A/B").alias("test_set")],
                                 *[F.col("id").alias(n) for n in numbers], *[F.lit(0.5).alias(n) for n in ("precision", "recall", "f1")])
    write_reports(rows, str(tmp_path))
    assert seen.value == 5
    assert spark.read.csv(f"{tmp_path}/summary", header=True).count() == spark.read.json(f"{tmp_path}/runs").count() == 5


def test_wide_rows_are_written_by_bytes(spark):
    rows = spark.range(0, 12, 1, 1).select("id", F.expr("transform(sequence(1, 20000), i -> sha2(concat(id, '-', i), 512))").alias("payload"))
    scratch = Scratch(spark)
    made = scratch.write(rows.repartition(1))
    (part,) = [f for f in Path(made.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet")]
    # 12 rows of 2.5 MB: at 8 MB a group, some groups instead of one of all rows
    groups = pq.ParquetFile(part).metadata
    assert groups.num_rows == 12 and groups.num_row_groups == 1
    spark.conf.set("parquet.block.size", 8 << 20)
    try:
        made = scratch.write(rows.repartition(1))
    finally:
        spark.conf.unset("parquet.block.size")
    (part,) = [f for f in Path(made.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet")]
    assert pq.ParquetFile(part).metadata.num_row_groups > 2


def test_submissions_without_key_are_not_ranked(spark, monkeypatch):
    ranked = []
    monkeypatch.setattr(assign, "rank_in_group", lambda df, *a, **b: ranked.append(df) or rank_in_group(df, *a, **b))
    sub = spark.createDataFrame([("r", i, None if i % 2 else "k") for i in range(20)], "run string, sub_pos bigint, key string")
    gt = spark.createDataFrame([("k", f"f{i}", i) for i in range(6)], "key string, file_name string, gt_pos bigint")
    got = {r.sub_pos: (r.key, r.mapped) for r in assign_unique(sub, gt, ["run"], []).collect()}
    assert got == {i: ("\u0000", None) if i % 2 else ("k", f"f{i // 2}" if i < 12 else None) for i in range(20)}
    assert max(df.count() for df in ranked) == 10


def test_sqlite_score_evaluates_its_inputs_once(spark):
    """Both tables are read by several steps; what makes them must run once for each row."""
    seen = spark.sparkContext.accumulator(0)

    def note(value):
        seen.add(1)
        return value

    counted = F.udf(note, "string")
    runs = spark.createDataFrame(
        [("r1", "SFT01", "S-1", "a.db", None, {"k": "1"}, None), ("r2", "SFT05", "S", "a.db", None, {"base_test_case": "S-1"}, None), ("r3", "SFT03", "S-2", "b.db", None, None, ["x", "y"])],
        "run_id string, task_id string, base_test_case string, file_name string, sqlite_table_name string, attributes map<string,string>, file_lines array<string>",
    ).withColumn("base_test_case", counted("base_test_case"))
    gt = spark.createDataFrame(
        [("S-1", "a.db", None, None, None, 1, {"k": "1.0"}), ("S-2-win", "b.db", None, None, "x", 2, None), ("S-2-win", "b.db", None, None, "z", 3, None)],
        "base_test_case string, file_name string, sqlite_table_name string, sqlite_cmd string, file_line string, gt_pos long, attributes map<string,string>",
    ).withColumn("file_name", counted("file_name"))
    got = {r.run_id: (r.tp, r.fp) for r in sqlite_score(runs, gt).collect()}
    assert got == {"r1": (1, 0), "r2": (1, 0), "r3": (1, 1)}
    assert seen.value == 6


def test_cases_have_only_prefixes_of_asked_lengths(spark):
    gt = spark.createDataFrame([("Case-1",), ("Case-12 ",), ("x",), ("",), (None,)], "base_test_case string")
    runs = spark.createDataFrame([("CASE-1",), ("case",), ("",), (None,), ("y",)], "base_test_case string")
    found = cases_with_prefix(gt, runs)
    assert sorted((r.asked, r._case) for r in found.collect()) == [("case", "case-1"), ("case", "case-12"), ("case-1", "case-1"), ("case-1", "case-12")]
    assert cases_with_prefix(gt, runs.limit(0)).count() == 0


def test_sectors_meet_partitions_as_in_plain_python(spark):
    """Overlapping, unsorted and null partitions, images without any; the array expressions are for odd rows only."""
    random.seed(11)
    big = 1 << 55
    some = lambda: random.choice([None, *range(0, 120, 3)])
    parts = [(random.choice("abc"), some(), some(), random.choice(["p", "q", "r", "s", None])) for _ in range(40)] + [("a", big, big + 9, "far")]
    files = []
    for i in range(300):
        spans = [(lo := random.randrange(-5, 125), lo + random.randrange(60)) for _ in range(random.randrange(4))]
        files.append((i, random.choice(["a", "b", "c", "none", None]), random.choice([None, spans, spans, spans])))
    files += [(900, "a", [(big + 1, big + 2)]), (901, "a", [(None, 5), (7, None)])]
    frame = spark.createDataFrame(files, "id int, image string, ranges array<struct<s:bigint,e:bigint>>")
    table = spark.createDataFrame(parts, "image string, start bigint, end bigint, name string")
    made = sectors.sector_to_partition(frame, table, ["image"])
    got = {r.id: (r.partitions, r.status) for r in made.collect()}
    assert made.columns == ["image", "id", "ranges", "partitions", "status"]
    assert "ArrowEvalPython" in made._jdf.queryExecution().optimizedPlan().toString()
    first = lambda v: (v is not None, v if v is not None else 0)
    for i, image, ranges in files:
        known = sorted((p[1:] for p in parts if p[0] == image), key=lambda p: (first(p[0]), first(p[1]), (p[2] is not None, p[2] or "")))
        hold = lambda x: next((n for a, b, n in known if None not in (a, b, x) and a <= x <= b), None)
        names = set()
        for s, e in ranges or []:
            a, b = hold(s), hold(e)
            names |= {a} if a is not None and a == b else {a, b, hold((s + e) // 2 if None not in (s, e) else None)}
        want = sorted(names - {None})
        assert got[i] == ("|".join(want), ["NO_MATCH", "OK", "CROSSES_PARTITIONS"][min(2, len(want))]), (i, ranges)
