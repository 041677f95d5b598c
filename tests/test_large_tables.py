"""Steps that took too much disk, memory or time on large tables: results beside plain Python, and what the cost hangs on."""

import random

import numpy as np
from pyspark.sql import functions as F

from exhume import session
from exhume.operators import byte_blocks, contains, file_match
from exhume.operators.assign import assign_unique


def test_texts_meet_tokens_by_the_rarest_pieces_of_their_windows(spark):
    rng = random.Random(1)
    texts = [(i % 3 if i % 11 else None, "".join(rng.choice("abé\U0001f600-") for _ in range(rng.randrange(0, 26))) if i % 7 else None) for i in range(200)]
    texts += texts[:20]  # a text given twice is met twice
    tokens = set()
    for k, t in texts:
        if t and len(t) > 3:
            at = rng.randrange(len(t))
            tokens.add((k, t[at : at + rng.randrange(1, 20)]))
    asked = [*tokens, (0, ""), (1, None), (None, "a"), (2, "ab")]
    asked += asked[:5]
    found = contains.containment_join(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(asked, "k int, x string"), "t", "x", ["k"])
    want = [(k, t, x) for k, t in texts for j, x in asked if k is not None and k == j and t and x and x in t]
    assert sorted((r.k, r.t, r.x) for r in found.collect()) == sorted(want)


def test_a_text_is_dealt_by_few_of_its_pieces(spark):
    names = [f"f{i:08d}-{i % 7}.txt" for i in range(0, 40_000_000, 20_011)]
    tokens = [n[2:] for n in names] + ["7-1.txt", "12-3.txt"]  # 13 letters, and a few short ones
    texts = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    sizes = sorted({contains._piece(len(t)) for t in tokens})
    places = contains._sketch(texts, "name", sizes)
    slots = {n: i for i, n in enumerate(sorted({len(t) for t in tokens}))}
    bit = contains._anchors(places, 20, slots)
    chosen = np.zeros(len(slots) << 17, np.uint8)
    for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(bit("t").alias("a")).collect():
        chosen[r.a[1] >> 3] |= 1 << (r.a[1] & 7)
    offered = texts.select(F.sum(F.size(contains._offers(places, 20, slots, chosen)("name"))).alias("n")).first().n
    pieces = sum(len(n) - size + 1 for n in names for size in sizes)
    assert offered < 3.5 * len(names) < pieces / 5


def shuffled(spark) -> set[str]:
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(held.apply(i).getName()) for i in range(held.size()) if str(held.apply(i).getName()).endswith(".data")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    import time

    before, setting = shuffled(spark), spark.conf.get(session.FREED, None)
    held = session.Scratch(spark).write(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before and spark.conf.get(session.FREED, None) == setting
    assert held.agg(F.sum("n")).first()[0] == 50_000


def test_assigned_rows_are_written(spark):
    sub = spark.createDataFrame([("r", i, f"k{i % 4}") for i in range(40)], "run string, sub_pos bigint, key string")
    gt = spark.createDataFrame([(f"k{i % 5}", f"f{i}", i) for i in range(30)], "key string, file_name string, gt_pos bigint")
    made = assign_unique(sub, gt, ["run"], [])
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString()
    assert made.filter("mapped is not null").count() == 24


def test_names_are_keyed_for_the_systems_of_a_case(spark):
    gt = spark.createDataFrame([("a", "f1", "p1", "x", 1, 2, 1), ("a", "f1", "p2", "y", 3, 4, 2), ("b", None, "p3", "z", 5, 6, 1)], "_case string, fat_key string, plain_key string, file_name string, size int, set_size int, gt_pos int")
    kinds = spark.createDataFrame([("a", True), ("b", False), ("b", None), ("c", True)], "_case string, is_fat boolean")
    every = {tuple(r) for r in file_match.name_index(gt).collect()}
    some = {tuple(r) for r in file_match.name_index(gt, kinds).collect()}
    assert some == {("a", "f1", "x", 1, 2), ("b", "p3", "z", 5, 6)} and some < every


def test_first_blocks_are_counted_from_the_rows(spark):
    gt = spark.createDataFrame([("a", 5, n, s, k, p) for p, (n, s, k) in enumerate([("x", 1, 9), ("x", 2, 4), ("y", 3, 7), ("z", 8, 8), ("w", None, 1)])] + [("a", None, "q", 1, 1, 9), ("b", 5, "x", 6, 2, 0)],
        "_case string, first_block int, file_name string, size int, set_size int, gt_pos int")
    got = {r._case: (r.f_rows, r.f_size, [tuple(x) for x in r.f_sets]) for r in file_match.first_block_index(gt).collect()}
    assert got == {"a": (5, None, [(1, "w"), (7, "y"), (8, "z")]), "b": (1, 6, [(2, "x")])}


def test_blocks_go_to_the_vote_by_number(spark):
    rows = spark.createDataFrame([(1, bytearray(b"aaaabbbbcccc"))], "pair int, content binary")
    cut = byte_blocks.byte_blocks(rows, ["pair"], block_size=4)
    named = byte_blocks.named_blocks(cut, ["pair"])
    assert named.columns == ["pair", "_block", "index", "offset", "size"] and byte_blocks.named_blocks(named, ["pair"]) is named
    vote = byte_blocks.alignment_vote(cut, cut, ["pair"], 4)
    found = byte_blocks.aligned_matches(named, cut, vote, ["pair"])
    assert "hash" not in found.columns and {(r.c_index, r.o_index, r.size) for r in found.collect()} == {(i, i, 4) for i in range(3)}
