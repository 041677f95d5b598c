"""Assignment, ordered helpers, alignment and fingerprints against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from exhume.functions import kernels
from exhume.operators import assign, byte_blocks, ordered
from exhume.operators.contains import containment_join
from exhume.operators.fingerprint import fingerprint64, image_lowfreq, nearest_original
from exhume.sources.inputs import read_images


def greedy(sub, gt):
    """Submissions in order, first row with the key whose name is free."""
    out = {}
    for run in {r for r, *_ in sub}:
        taken = set()
        for _r, _s, key, pos in sorted((x for x in sub if x[0] == run), key=lambda x: x[3]):
            names = [n for s, k, n, _p in sorted(gt, key=lambda x: x[3]) if s == _s and k == key and n not in taken]
            out[run, pos] = names[0] if names else None
            taken.update(names[:1])
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_assignment_equals_greedy(spark, unique):
    rng = random.Random(3)
    gt, sub = [], []
    for scope in ("a", "b", "c"):
        for p in range(14):
            name = f"n{p}" if unique else f"n{rng.randrange(6)}"
            gt.append((scope, f"k{rng.randrange(4)}", name, p))
        for run in (scope + "1", scope + "2"):
            sub += [(run, scope, f"k{rng.randrange(5)}", p) for p in range(12)]
    s = spark.createDataFrame(sub, "run string, scope string, key string, sub_pos long")
    g = spark.createDataFrame(gt, "scope string, key string, file_name string, gt_pos long")
    got = {(r["run"], r["sub_pos"]): r["mapped"] for r in assign.assign_unique(s, g, ["run"], ["scope"]).collect()}
    assert got == greedy(sub, gt)


def counted_rounds(monkeypatch):
    rounds = []
    judge = assign._undisturbed
    monkeypatch.setattr(assign, "_undisturbed", lambda *a: rounds.append(1) or judge(*a))
    return rounds


def assigned(spark, sub, gt):
    s = spark.createDataFrame(sub, "run string, scope string, key string, sub_pos long")
    g = spark.createDataFrame(gt, "scope string, key string, file_name string, gt_pos long")
    return {(r["run"], r["sub_pos"]): r["mapped"] for r in assign.assign_unique(s, g, ["run"], ["scope"]).collect()}


def test_independent_collisions_share_their_rounds(spark, monkeypatch):
    """Many pairs of keys, each with one shared name: no more rounds than for one pair."""
    rounds = counted_rounds(monkeypatch)
    gt, sub = [], []
    for i in range(60):
        gt += [("s", f"a{i}", f"n{i}", 4 * i), ("s", f"b{i}", f"n{i}", 4 * i + 1), ("s", f"b{i}", f"m{i}", 4 * i + 2)]
        sub += [("r", "s", f"a{i}", 2 * i), ("r", "s", f"b{i}", 2 * i + 1)]
    assert assigned(spark, sub, gt) == greedy(sub, gt) and len(rounds) <= 3


def test_one_linked_group_takes_the_rounds_of_its_longest_chain(spark, monkeypatch):
    """One key shares a name with each of 10,000 others: all collide, but nobody waits for more than one."""
    rounds = counted_rounds(monkeypatch)
    gt, sub = [], []
    for i in range(10_000):
        gt += [("s", "x", f"h{i}", 3 * i), ("s", f"y{i}", f"h{i}", 3 * i + 1), ("s", f"y{i}", f"o{i}", 3 * i + 2)]
        sub += [("r", "s", "x", 2 * i), ("r", "s", f"y{i}", 2 * i + 1)]
    got = assigned(spark, sub, gt)
    assert all(got["r", 2 * i] == f"h{i}" and got["r", 2 * i + 1] == f"o{i}" for i in range(10_000)) and len(rounds) <= 3


@pytest.mark.parametrize("seed", range(2))
def test_tangled_lists_equal_greedy(spark, seed):
    rng = random.Random(seed)
    gt, sub = [], []
    for scope in ("a", "b"):
        for key in range(6):
            gt += [(scope, f"k{key}", f"n{rng.randrange(10)}", 20 * key + i) for i in range(rng.randrange(1, 9))]
        for run in ("1", "2"):
            sub += [(scope + run, scope, rng.choice([f"k{rng.randrange(7)}", None]), p) for p in rng.sample(range(100), 30)]
    want = {k: v for k, v in greedy([(r, s, k or "?", p) for r, s, k, p in sub], gt).items()}
    assert assigned(spark, sub, gt) == want


def test_rank_and_carry_with_tiny_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), i, rng.choice([None, f"v{i}"])) for i in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "g string, pos long, v string")
    got = {(r["g"], r["pos"]): (r["rn"], r["last"]) for r in ordered.carry_forward(
        ordered.rank_in_group(df, ["g"], "pos", "rn", width=7), ["g"], "pos", F.col("v"), "last", width=7).collect()}
    for g in "xyz":
        last = None
        for n, (_g, pos, v) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            last = v or last
            assert got[g, pos] == (n, last)


def test_null_groups_and_positions_stay(spark):
    rows = [(None, 1, "a"), (None, 2, None), ("x", None, "b"), ("x", 3, None), ("x", 9, "c"), ("x", 20, None)]
    df = spark.createDataFrame(rows, "g string, pos long, v string")
    got = {(r["g"], r["pos"]): (r["rn"], r["last"]) for r in ordered.carry_forward(
        ordered.rank_in_group(df, ["g"], "pos", "rn", width=7), ["g"], "pos", F.col("v"), "last", width=7).collect()}
    assert got == {(None, 1): (1, "a"), (None, 2): (2, "a"), ("x", None): (1, "b"), ("x", 3): (2, "b"), ("x", 9): (3, "c"), ("x", 20): (4, "c")}


def test_islands_and_intervals_with_tiny_buckets(spark):
    rng = random.Random(2)
    nums = sorted({("g", rng.randrange(200)) for _ in range(140)})
    runs = ordered.islands(spark.createDataFrame(nums, "g string, i long"), ["g"], "i", width=5).collect()
    covered = sorted(n for r in runs for n in range(r["lo"], r["hi"] + 1))
    assert covered == [i for _g, i in nums] and all(r["hi"] + 1 not in set(covered) for r in runs)
    spans = [("g", s, s + rng.randrange(1, 9)) for s in (rng.randrange(300) for _ in range(60))]
    merged = ordered.merge_intervals(spark.createDataFrame(spans, "g string, s long, e long"), ["g"], "s", "e", width=11).collect()
    assert sorted(n for r in merged for n in range(r["lo"], r["hi"])) == sorted({n for _g, s, e in spans for n in range(s, e)})
    edges = sorted((r["lo"], r["hi"]) for r in merged)
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("segment", [8, 2048])
def test_alignment_vote_on_repeated_blocks(spark, monkeypatch, segment):
    """Lists of any length give the same votes and the same first match."""
    monkeypatch.setattr(byte_blocks, "SEGMENT", segment)
    rng = random.Random(5)
    files = {p: ("".join(rng.choice("ab") for _ in range(40)), "".join(rng.choice("ab") for _ in range(33))) for p in range(6)}

    def cut(side):
        rows = [(p, bytearray("".join(x * 4 for x in t[side]).encode())) for p, t in files.items()]
        return byte_blocks.byte_blocks(spark.createDataFrame(rows, "pair int, content binary"), ["pair"], block_size=4)

    got = {r["pair"]: (r["offset"], r["votes"], r["candidates"]) for r in byte_blocks.alignment_vote(cut(0), cut(1), ["pair"], 4).collect()}
    for p, (o, c) in files.items():
        votes, first = {}, {}
        for ci, x in enumerate(c):
            for oi, y in enumerate(o):
                if x == y:
                    votes[oi - ci] = votes.get(oi - ci, 0) + 1
                    first.setdefault(oi - ci, (ci, oi))
        best = min(votes, key=lambda d: (-votes[d], first[d]))
        assert got[p] == (best * 4, votes[best], sum(votes.values()))


def test_zero_and_partial_blocks(spark):
    df = spark.createDataFrame([(1, bytearray(b"\0" * 4 + b"abcd" + b"xy"))], "id int, content binary")
    rows = lambda **k: [(r["index"], r["offset"], r["size"]) for r in byte_blocks.byte_blocks(df, ["id"], block_size=4, **k).orderBy("index").collect()]
    assert rows() == [(1, 4, 4), (2, 8, 2)]
    assert rows(include_partial=False) == [(1, 4, 4)]
    assert rows(ignore_zero=False) == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]


def test_run_summaries_join(spark):
    from exhume.operators.byte_compare import byte_compare

    rng = random.Random(9)
    pairs = [(i, bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))), bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))), rng.randrange(-6, 7)) for i in range(40)]
    side = lambda j: spark.createDataFrame([(p[0], bytearray(p[j]), p[3]) for p in pairs], "id int, content binary, offset long")
    got = {r["id"]: r for r in byte_compare(side(1), side(2), ["id", "offset"], chunk=5).collect()}
    for i, o, c, off in pairs:
        a, b = o[max(off, 0):], c[max(-off, 0):]
        n = min(len(a), len(b))
        same = [x == y for x, y in zip(a, b)]
        runs = "".join("1" if s else "0" for s in same).split("0")
        row = got[i]
        assert row["diff_bytes"] == same.count(False) + max(len(a), len(b)) - n
        assert row["longest_equal_run"] == max(map(len, runs))
        assert row["diff_bits"] == sum((x ^ y).bit_count() for x, y in zip(a, b))
        expected = same.index(False) if False in same else (n if len(a) != len(b) else None)
        assert row["first_diff"] == expected


def test_nearest_original_with_copies(spark):
    rng = random.Random(4)
    gt = [("c", i, i, rng.choice([5, 9, 2**62, -3, None])) for i in range(30)]
    sub = [("c", i, rng.choice([4, 2**62 + 1, -1, None])) for i in range(12)]
    s = spark.createDataFrame(sub, "scope string, sub_id long, hash long")
    g = spark.createDataFrame(gt, "scope string, gt_id long, gt_pos long, hash long")
    got = {(r["sub_id"], r["rank"]): (r["gt_id"], r["dist"]) for r in nearest_original(s, g, ["scope"], ["sub_id"], 3).collect()}
    expected = {}
    for _c, i, h in sub:
        if h is not None:
            near = sorted((((h ^ x) & (2**64 - 1)).bit_count(), p, n) for _s, n, p, x in gt if x is not None)[:3]
            expected |= {(i, k): (n, d) for k, (d, _p, n) in enumerate(near, 1)}
    assert got == expected


def test_images(spark, tmp_path):
    side = 40
    rows = b"".join(bytes((x * 6 % 256, y * 5 % 256, 90)) for y in range(side) for x in range(side))
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + side.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "good.bmp").write_bytes(head + info + rows)
    (tmp_path / "bad.png").write_bytes(b"no image")
    images = read_images(spark, str(tmp_path))
    assert {r["image"]["origin"].split("/")[-1]: r["decodes"] for r in images.collect()} == {"good.bmp": True, "bad.png": False}
    low = image_lowfreq(images).withColumn("hash", fingerprint64(F.col("values"))).collect()
    assert sorted(r["hash"] is not None for r in low) == [False, True]


def test_containment_with_many_tokens(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abc") for _ in range(60))) for i in range(20)]
    tokens = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 22))),) for _ in range(60)]
    t, k = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(sorted(set(tokens)), "k string")
    got = sorted((r["id"], r["k"]) for r in containment_join(t, k, "t", "k").collect())
    assert got == sorted((i, x) for i, s in texts for (x,) in set(tokens) if x in s)


def test_run_summary_kernel():
    import numpy as np

    assert kernels.run_summary(np.array([]), 4) == (4, 4, 4, 4)
    assert kernels.run_summary(np.array([0, 5]), 6) == (6, 0, 0, 4)


def test_wide_search_beside_letters_beyond_ascii(spark):
    from exhume.operators.raw_search import keyword_search_raw

    texts = ["Grün und blau und \U0001f600und", "été und", "und", "\u0575\u6e00 und 東京und"]
    blobs = [(i, t.encode("utf-16-le")) for i, t in enumerate(texts)]
    found = keyword_search_raw(spark.createDataFrame(blobs, "doc_id bigint, content binary"), ["und"], "doc_id", ignore_case=False).collect()
    want = {(i, len(t[:k].encode("utf-16-le"))) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith("und", k)}
    # the zero-byte view may meet the same letters from the zero byte before them too
    got = {(r.doc_id, r.offset) for r in found}
    assert want <= got and all((i, at) in want or (i, at + 1) in want for i, at in got)


def test_nearest_original_deals_lists_of_one_case(spark, monkeypatch):
    """All pairs of lists of one case are met, in several tasks; distances of many lists give the same nearest."""
    from exhume.operators import fingerprint

    monkeypatch.setattr(fingerprint, "SEGMENT", 16)
    monkeypatch.setattr(fingerprint, "BESIDE", 3)
    rng = random.Random(11)
    gt = [("c", i, i, rng.randrange(-(2**63), 2**63)) for i in range(90)]
    sub = [("c", i, gt[i][3] ^ (1 << rng.randrange(63)) if i % 2 else rng.randrange(2**40)) for i in range(70)]
    s = spark.createDataFrame(sub, "scope string, sub_id long, hash long")
    g = spark.createDataFrame(gt, "scope string, gt_id long, gt_pos long, hash long")
    tiles = fingerprint._tiles(s.select("scope", "hash").distinct(), g.select("scope", "hash", F.col("gt_pos").alias("pos")), ["scope"])
    dealt = [r["n"] for r in tiles.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(dealt) >= 20 and len(dealt) > 1
    got = {(r["sub_id"], r["rank"]): (r["gt_id"], r["dist"]) for r in nearest_original(s, g, ["scope"], ["sub_id"], 4).collect()}
    expected = {}
    for _c, i, h in sub:
        near = sorted((((h ^ x) & (2**64 - 1)).bit_count(), p, n) for _s, n, p, x in gt)[:4]
        expected |= {(i, k): (n, d) for k, (d, _p, n) in enumerate(near, 1)}
    assert got == expected


def test_rare_blocks_vote_without_lists(spark, monkeypatch):
    """Blocks that a side has few of are counted as rows; no list of them goes to the kernel."""
    def refuse(frames, keys):
        for _ in frames:
            raise AssertionError("a list for a rare block")
        yield from ()

    rng = random.Random(6)
    texts = {p: "".join(rng.sample("abcdefghijklmnop", 16)) for p in range(4)}

    def cut(shift):
        rows = [(p, bytearray("".join(x * 4 for x in t[shift:]).encode())) for p, t in texts.items()]
        return byte_blocks.byte_blocks(spark.createDataFrame(rows, "pair int, content binary"), ["pair"], block_size=4)

    monkeypatch.setattr(byte_blocks, "correlate", refuse)
    got = {tuple(r) for r in byte_blocks.alignment_vote(cut(0), cut(3), ["pair"], 4).collect()}
    assert got == {(p, 12, 13, 13) for p in texts}


@pytest.mark.parametrize("few", [0, 4])
def test_a_file_given_twice_votes_alike_as_rows_and_lists(spark, monkeypatch, few):
    monkeypatch.setattr(byte_blocks, "FEW", few)
    rows = [(1, bytearray(b"aaaabbbbcccc"))] * 2
    cut = byte_blocks.byte_blocks(spark.createDataFrame(rows, "pair int, content binary"), ["pair"], block_size=4)
    assert [tuple(r) for r in byte_blocks.alignment_vote(cut, cut, ["pair"], 4).collect()] == [(1, 0, 6, 12)]
