"""SimHash groups, resampling and spelling variants beside brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from exhume.llm import near_duplicates, queries, resampling, simhash, sorted_groups, spelling
from exhume.session import Scratch
from llm.test_operators import corpus, docs, none, prose  # noqa: F401

DATA = "/root/testdata/sf0.001"


# --- groups of sorted rows


def test_groups_are_never_cut():
    rows = [(g, i) for g, n in enumerate((1, 7, 2, 1, 30, 3)) for i in range(n)]
    batches = [pa.RecordBatch.from_pylist([{"g": g, "i": i} for g, i in rows[a : a + 4]], pa.schema([("g", pa.int64()), ("i", pa.int64())])) for a in range(0, len(rows), 4)]
    tables = list(sorted_groups.whole_groups(iter([batches[0].slice(0, 0), *batches]), "g"))
    assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == rows
    firsts = [set(t["g"].to_pylist()) for t in tables]
    assert not any(a & b for a, b in combinations(firsts, 2))
    assert sorted_groups.bounds(tables[-1]["g"]).tolist()[-1] == tables[-1].num_rows
    assert list(sorted_groups.whole_groups(iter([]), "g")) == []


# --- simhash


def plain_fingerprint(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """{place: least id} by comparing all pairs."""
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(key, fp[i], least.get(top(i))) for i, (key, _) in enumerate(rows)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_simhash_as_brute_force(docs, none):  # noqa: F811
    rows = [(r[0], r[1]) for r in corpus()]
    got = Counter((r.key, r.fp, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((k, signed(f), c) for k, f, c in brute_components(rows))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_query_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_simhash_near_dedup(spark, DATA).collect()}
    assert got == {(k, f"{f:016x}", c) for k, f, c in brute_components(rows)}
    assert len({c for _, _, c in got}) < len(got)


def test_golay_code_is_perfect():
    every = simhash.nearest(np.arange(1 << 23))
    assert (np.bincount(every, minlength=4096) == 2048).all()
    words = np.random.default_rng(3).integers(0, 1 << 23, 3000)
    keys, near = simhash.fuzzy_keys(words), simhash.nearest(words)
    assert (keys == near[:, None]).any(1).all()
    for bit in range(23):  # the nearest codeword of any word one bit away is among the keys
        assert (keys == simhash.nearest(words ^ (1 << bit))[:, None]).any(1).all()


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_fingerprints_up_to_three_bits_apart_share_a_key(errors):
    draw = np.random.default_rng(errors)
    a = draw.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2) + draw.integers(0, 2, 4000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in draw.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        place, made = simhash.join_keys(x)
        keys.append([set(y.tolist()) for y in np.split(made, np.searchsorted(place, np.arange(1, len(x))))])
    assert all(x & y for x, y in zip(*keys))
    assert max(map(len, keys[0])) <= 78


def test_links_of_a_large_group_and_of_chains(spark):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    group = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for _ in range(5000)}
    chain, at = [], draw.getrandbits(64)
    for bit in range(40):
        chain.append(at)
        at ^= 1 << bit | 1 << (bit + 5) % 64 | 1 << (bit + 11) % 64
    alone = [draw.getrandbits(64) for _ in range(300)]
    frame = spark.createDataFrame([(signed(x),) for x in {*group, *chain, *alone}], "fp bigint").repartition(5)
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in simhash.links(frame).collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 3 or r.v < r.u
        parent[top(r.u)] = top(r.v)
    assert len({top(signed(x)) for x in group}) == len({top(signed(x)) for x in chain}) == 1
    assert len({top(signed(x)) for x in [centre, chain[0], *alone]}) == len(alone) + 2


# --- resampling


def brute_resample(rows, target, buckets=10_000, longest=1, percent=10, min_words=20, seed=2024):
    def found(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [found(t) for _, t in rows]
    s, t = Counter(b for _, x in own for b in x), Counter(b for x in target for b in found(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    out = []
    for (key, _), (n, x) in zip(rows, own):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (45, 2), (100, 1)])
def test_resampling_as_brute_force(spark, docs, none, percent, longest):  # noqa: F811
    rows = [(r[0], r[1]) for r in corpus()]
    target = ["the river, the stone.", None, "fish fish blue", ""]
    aim = spark.createDataFrame([(t,) for t in target], "aim string")
    got = resampling.resample(docs, aim, target_text="aim", percent=percent, longest=longest, carry=("text", "score")).collect()
    want, drawn = brute_resample(rows, target, longest=longest, percent=percent)
    flat = lambda x: Counter(map(tuple, x))
    assert flat((r.key, r.n_words, r.n_features, r.weight, r[6]) for r in got) == flat(want)
    assert [(r.key, r[6]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(x[0], x[4]) for x in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert Counter((r.key, r.text) for r in got) == Counter(rows)
    assert resampling.resample(none, aim, target_text="aim", percent=percent).count() == 0
    assert resampling.resample(docs, none, percent=percent).count() == len(rows)


@pytest.mark.parametrize(("kind", "wanted"), [("spread", 1), ("spread", 777), ("spread", 8000), ("one value", 777), ("two values", 4000)])
def test_bracket_and_draw(spark, kind, wanted):
    value = {"spread": F.xxhash64("id") % 1000, "one value": F.lit(3), "two values": F.when(F.col("id") % 3 == 0, 9).otherwise(1)}[kind]
    scratch = Scratch(spark)
    scored = scratch.write(spark.range(8000).select(F.col("id").alias("key"), value.cast("bigint").alias("score"), F.col("id").alias("tie")).repartition(3))
    low, high, above = resampling.bracket(scored, 8000, wanted)
    assert scored.filter(F.col("score") > high).count() == above < wanted <= scored.filter(F.col("score") >= low).count()
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("tie")]
    got = sorted((r["rank"], -r.score, r.key) for r in resampling.draw(scored, wanted, 8000, order, scratch).collect())
    want = sorted((-r.score, r.key) for r in scored.collect())[:wanted]
    assert got == [(i + 1, *x) for i, x in enumerate(want)]


def test_a_bracket_that_misses_is_widened(spark):
    # with no slack the two quantiles are one value, and among few equal values exact counts have to settle it
    scored = spark.range(1000).select((F.col("id") % 7).alias("score"))
    for wanted in (1, 143, 144, 1000):
        low, high, above = resampling.bracket(scored, 1000, wanted, slack=1e-9)
        assert above < wanted <= scored.filter(F.col("score") >= low).count()


# --- n-gram Jaccard join below its usual threshold


@pytest.mark.parametrize("threshold", [0.5, 0.65])
def test_sizes_may_differ_as_the_threshold_allows(spark, threshold):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(base[:n])) for i, n in enumerate((400, 300, 270, 225, 190, 150, 120, 100, 70))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    want = {i: sum(len(a & b) >= threshold * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert {r.key: r.n_links for r in near_duplicates.near_duplicates(frame, threshold=threshold).collect()} == want


# --- spelling


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_variants(rows, min_count=3):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return Counter(out)


def variant_rows(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def noisy(seed: int) -> str:
    draw, words = random.Random(seed), ["straße", "river", "rivers", "fleuve", "übermut", "maison", "réponse", "stone", "÷×aßé", "walking"]
    out = []
    for _ in range(400):
        w = list(draw.choice(words))
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            at = draw.randrange(len(w))
            w[at : at + draw.randrange(2)] = draw.choice(["", "e", "é", "ß"])
            if not w:
                w = ["q"]
        out.append("".join(w) + draw.choice([" ", "-", "\n", "東", "\U0001f600", "š", " The "]))
    return "".join(out)


def test_variants_as_brute_force(spark, docs, none):  # noqa: F811
    rows = [(i if i % 5 else None, noisy(i)) for i in range(40)] + [(7, None), (8, ""), (9, "A" * 30_000), (9, noisy(3)), (9, noisy(3))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("?"), "word": F.lit("?"), "cell": F.lit(1)}).repartition(3)
    got, want = variant_rows(spelling.variants(frame)), brute_variants(rows)
    assert got == want and sum(r[4] for r in want) > 500 and any(r[2] != (r[1] or r[0]) for r in want)
    assert variant_rows(spelling.variants(docs)) == brute_variants([(r[0], r[1]) for r in corpus()])
    assert spelling.variants(none).count() == 0


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 8)
    rows = [(i, noisy(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert variant_rows(spelling.variants(frame, min_count=1)) == brute_variants(rows, 1)


def test_sorted_lists_give_all_pairs_one_edit_apart():
    draw = random.Random(4)
    for size in (0, 1, 2, 5, 60, 300):
        words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 8))) for _ in range(size)})
        got = list(spelling.one_edit_apart(words))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, j in combinations(range(len(words)), 2) if abs(len(words[i]) - len(words[j])) < 2 and edits(words[i], words[j]) == 1}


def test_forms_lead_to_the_last(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [("a", "w000"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark)).collect()}
    assert got == {w: "w040" for w, _ in chain if w != "b"} | {"b": "c"}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "doc_id bigint, text string"), factor=1)
