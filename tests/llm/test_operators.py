"""The operators for training data beside brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from exhume.llm import (
    decontamination,
    html_extraction,
    language_id,
    line_dedup,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    token_files,
    warc,
)
from exhume.operators.components import components
from exhume.llm.shared_files import coalesced
from exhume.llm.tokens import encoder, vocabulary
from exhume.session import Scratch

WORDS = ["the", "of", "house", "Tree", "was", "river,", "über", "ça", "stone.", "and", "to", "fish", "blue", "walk", "night"]
# columns that operators make for themselves, and one nobody needs
CLASHES = "stats string, score string, hits string, kept string, cuts string, key string, th string, n_lines string"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", str(draw.randrange(40))]) for _ in range(words))


def corpus() -> list[tuple]:
    long = prose(1, 300)
    lines = "\n".join(prose(90 + i, 15) for i in range(6))
    near = long.split()
    near[150] = "changed"
    rows = [
        (1, long), (2, long), (3, " ".join(near)), (4, prose(2, 200)), (5, None), (6, ""), (7, " \n\t "), (8, "short text"), (9, "short text"),
        (10, lines + "\n" + prose(3, 30)), (11, prose(4, 30) + "\n" + lines), (12, "ha " * 400), (13, "x\n" * 120), (14, prose(5, 9000)),
        (None, prose(6, 40)), (None, prose(6, 40)), (15, prose(7, 80)), (15, prose(7, 80)), (15, prose(8, 80)), (16, "12 34 $$$ <|endoftext|> it's 5'll"),
        (17, "á É ΑΣ     x\x1cy 東京 ﬁ \U0001f600"),
    ]
    return [(i, t, None, "s", 0) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    clash = ["?"] * 8
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
    return spark.createDataFrame([(*r, *clash) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("files"))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- quality rules


def test_rules_count_as_brute_force_does(docs, none):
    got = quality_rules.apply_rules(docs)
    assert quality_rules.apply_rules(none).count() == 0
    seen = Counter()
    for r in got.collect():
        w = words_of(r.text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
        lines = [x for x in (r.text or "").split("\n") if words_of(x)]
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert s.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or "")) and s.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.kept and r.base_failed)
        seen[r.kept] += 1
    assert seen[True] and seen[False] and sum(seen.values()) == docs.count()


# --- quality classifier


def test_classifier_tells_junk_from_prose(spark):
    rows = [(i, prose(i, 60 + i % 50), 1) for i in range(120)] + [(200 + i, "A!! $$$ ### | " * (5 + i % 30), 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    featured = quality_classifier.with_features(labelled)
    model = quality_classifier.fit(featured.filter("doc_id % 2 = 0"))
    held = quality_classifier.score(featured.filter("doc_id % 2 = 1"), model).collect()
    assert all(r.predicted == r.quality and 0 <= r.score <= 1 for r in held)
    # the same densities from numpy, without Cholesky factors
    data = {r.doc_id: r for r in featured.collect()}
    x = {i: np.array([r[n] for n in quality_classifier.features()]) for i, r in data.items()}
    train = [i for i in data if i % 2 == 0]
    by = [np.array([x[i] for i in train if data[i].quality == c]) for c in (0, 1)]
    total = np.array([x[i] for i in train])
    scale = np.sqrt(np.maximum(total.var(0), 1e-6))
    cov = [np.cov(b.T, bias=True) / np.outer(scale, scale) for b in by]
    pooled = sum(len(b) * c for b, c in zip(by, cov)) / len(total)
    mixed = [(1 - quality_classifier.TO_POOLED) * c + quality_classifier.TO_POOLED * pooled for c in cov]
    full = [(1 - quality_classifier.TO_DIAGONAL) * m + quality_classifier.TO_DIAGONAL * np.eye(len(m)) * max(np.trace(m) / len(m), 1e-3) for m in mixed]
    for r in held[:20]:
        d = [(x[r.doc_id] - b.mean(0)) / scale for b in by]
        logs = [math.log(len(b)) - 0.5 * (np.linalg.slogdet(f)[1] + v @ np.linalg.solve(f, v)) for b, f, v in zip(by, full, d)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, logs[1] - logs[0])))), abs=2e-6)


def test_classifier_without_two_classes(docs, none):
    featured = quality_classifier.with_features(docs)
    labelled = featured.withColumn("quality", F.lit(1))
    assert quality_classifier.fit(labelled) == 1.0
    assert quality_classifier.fit(labelled.withColumn("quality", F.lit(None).cast("int"))) == 0.5
    got = quality_classifier.score(featured, 0.5).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    assert quality_classifier.score(quality_classifier.with_features(none), 1.0).count() == 0


# --- language


def longest_match_phrases(text: bytes, reference: bytes, block: int) -> int:
    count = 0
    for at in range(0, len(text), block):
        piece, i = text[at : at + block], 0
        while i < len(piece):
            n = 1
            while i + n <= len(piece) and piece[i : i + n] in reference:
                n += 1
            i += max(n - 1, 1)
            count += 1
    return count


def test_phrases_equal_longest_matches():
    draw = random.Random(3)
    samples = {c: "".join(draw.choice(s) for _ in range(400)).encode() for c, s in (("a", "abcd "), ("b", "bcde "))}
    model = language_id.build(samples)
    texts = ["".join(draw.choice("abcde xyz") for _ in range(n)).encode() for n in (1, 7, 511, 512, 513, 1500)]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    got = language_id.phrases(model, np.frombuffer(b"".join(texts), np.uint8), bounds)
    for row, text in zip(got, texts):
        assert row.tolist() == [longest_match_phrases(text, samples[c], language_id.BLOCK) for c in ("a", "b")]


def test_languages_on_held_out_texts(spark, docs, none):
    def made(seed, letters):
        draw = random.Random(seed)
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 7))) for _ in range(60))

    rows = [(i, made(i, "abdeknt" if i % 2 else "ouilmré"), "x" if i % 2 else "y") for i in range(60)]
    model = language_id.train(spark.createDataFrame([*rows, (99, None, "x"), (98, "abc", None), (97, "...", "z")], "doc_id bigint, text string, lang string"))
    assert model.languages == ("x", "y")
    test = spark.createDataFrame([(i, made(i, "abdeknt" if i % 2 else "ouilmré"), "?") for i in range(100, 140)], "doc_id bigint, text string, score string")
    assert all(r.lang_pred == ("x" if r.doc_id % 2 else "y") and 0 < r.score <= 1 for r in language_id.predict(test, model).collect())
    got = language_id.predict(docs, model).collect()
    assert len(got) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    unlearned = language_id.train(docs)  # no row has a language
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, unlearned).collect()} == {("und", 0.0)}
    assert language_id.predict(none, model).count() == 0


def test_short_sample_of_one_language_leaves_the_others(spark):
    draw = random.Random(5)
    texts = {c: [" ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(50)) for _ in range(40)] for c, letters in (("x", "abdekn"), ("y", "abdeko"))}
    rows = [(t, c) for c, all_of in texts.items() for t in all_of[:30]] + [("ok", "xx")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("x", "xx", "y") and model.weights[0] > 12 and model.weights[2] > 12
    for c in ("x", "y"):
        assert language_id.judge(model, pa.array(texts[c][30:]))[0] == [c] * 10


def test_copies_do_not_crowd_out_a_language(spark):
    rows = [(i, prose(i, 40)) for i in range(20)]
    few = spark.createDataFrame(rows, "i bigint, text string")
    many = spark.range(200_000).select((F.col("id") % 20).alias("i")).join(F.broadcast(few), "i").select("text", F.lit("y").alias("lang"))
    empty = spark.range(200_000).select(F.lit(None).cast("string").alias("text"), F.lit("z").alias("lang"))
    lone = spark.createDataFrame([("abc abd", "z"), ("...", "w")], "text string, lang string")
    model = language_id.train(many.unionByName(empty).unionByName(lone))
    assert model.languages == ("y", "z")
    assert model.weights[0] >= math.log2(0.9 * sum(min(len(t), language_id.EXCERPT_CHARS) for _, t in rows))


# --- archives


def test_archives_round_trip(spark, folder):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (None, "http://c", big), (4, "x\r\ny%", "small"), (5, "http://d", "small"), (1, "http://b", big), (6, "u", "line\r\n\r\nline" * 20)]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id bigint, url string, html string, payload string").repartition(3)
    index = warc.write_archives(pages, f"{folder}/warc")
    got = warc.read_records(index).collect()
    want = Counter()
    for i, url, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 1
        want[(i, url, "revisit" if revisit else "response", 1 if revisit else None, len(data), hashlib.sha256(data).hexdigest(), None if revisit else data)] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got) == want
    some = warc.read_records(index.filter("page_id in (4, 6)")).collect()
    assert {r.page_id for r in some} == {4, 6}
    empty = warc.write_archives(pages.filter("false"), f"{folder}/none")
    assert empty.count() == 0 and warc.read_records(empty).count() == 0


def test_coalesced_ranges():
    ranges = [(0, 10), (10, 5), (20, 5), (10_000_000, 5), (10_000_005, 9_000_000), (19_000_010, 1)]
    got = list(coalesced(ranges))
    assert [r for _, _, held in got for r in held] == ranges
    assert [(a, b) for a, b, _ in got] == [(0, 25), (10_000_000, 10_000_005), (10_000_005, 19_000_011)] or got[0][:2] == (0, 25)


# --- tokens, packing


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(vocabulary()), encoder(vocabulary())
    texts = [t or "" for _, t, *_ in corpus()] + ["Don't stop-me'll X'S  a\r\nb\tc", "ÀÖ×÷ Straße İstanbul", "a<|startoftext|>b", "é́ ́x", "9,9 x9y !!'s"]
    draw = random.Random(4)
    latin = [chr(i) for i in range(256)] + ["'s", "'ll", "'RE", " ", "\n", "<|", "<|endoftext|>", "a", "é", "1"] * 3
    texts += ["".join(draw.choice(latin + ["東", "Σ", "ﬁ", "\u0301", "İ", "\u2003"] * (i % 2)) for _ in range(draw.randrange(1, 30))) for i in range(2000)]
    for text in texts:
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def brute_ids(text, end):
    return np.array([*Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_packing_places_every_piece(docs, none):
    got = packing.pack(docs, vocabulary(), capacity=256).collect()
    want = Counter()
    for i, text, *_ in corpus():
        ids = brute_ids(text, 1)
        for k, at in enumerate(range(0, len(ids), 1024)):
            own = ids[at : at + 1024]
            want[(i, k, at // 4, len(own) // 4, zlib.crc32(own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 256
    assert packing.pack(none, vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_and_wastes_little(seed):
    draw = np.random.default_rng(seed)
    capacity = int(draw.integers(1, 80))
    counts = np.zeros(capacity + 1, np.int64)
    for length in draw.integers(1, capacity + 1, int(draw.integers(0, 400))):
        counts[length] += 1
    bins = packing.plan(counts.copy())
    used = Counter()
    for items, count in bins:
        assert count > 0 and sum(a * b for a, b in items) <= capacity
        for length, times in items:
            used[length] += times * count
    assert used == Counter({i: int(n) for i, n in enumerate(counts) if n})
    bound = math.ceil(sum(i * n for i, n in enumerate(counts)) / capacity)
    assert bound <= sum(b.count for b in bins) <= max(1.25 * bound + 1, 0)


def test_sums_follow_what_is_left():
    draw = np.random.default_rng(5)
    left = draw.integers(0, 3, 40)
    left[0] = 0
    sums = packing.Sums(left.copy())
    for x in np.flatnonzero(left)[::2].tolist():
        sums.take(Counter([x]), int(sums.left[x]))
        present = np.flatnonzero(sums.left).tolist()
        pairs, triples = Counter(a + b for a in present for b in present), Counter(a + b + c for a in present for b in present for c in present)
        assert [sums.pair[s] for s in range(40)] == [pairs[s] for s in range(40)] and [sums.triple[s] for s in range(40)] == [triples[s] for s in range(40)]


# --- token files


def test_token_files_round_trip(spark, docs, none, folder):
    place = f"{folder}/tokens"
    index = token_files.write_corpus(docs, place, vocabulary())
    read = token_files.read_documents(index).join(token_files.global_starts(index), "file")
    got = sorted(((r.start + r.base, r.key, bytes(r.ids)) for r in read.collect()), key=lambda x: x[0])
    assert Counter((k, ids) for _, k, ids in got) == Counter((i, brute_ids(t, 2)) for i, t, *_ in corpus())
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids) // 4
    keys = [k for _, k, _ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    # a file alone tells where its documents are
    for uri in {r.file for r in index.collect()}:
        digest, width, rows = token_files.read_index(uri)
        own = sorted((r.offset, r.size, r.n_tokens) for r in index.filter(F.col("file") == uri).collect())
        assert [tuple(x) for x in rows.tolist()] == own and width == 2 and len(digest) == 32
    few = token_files.read_documents(index.filter("key in (4, 12)")).collect()
    assert {r.key: bytes(r.ids) for r in few} == {i: brute_ids(t, 2) for i, t, *_ in corpus() if i in (4, 12)}
    assert token_files.write_corpus(none, f"{folder}/no-tokens", vocabulary()).count() == 0


# --- decontamination


def test_hits_and_spans_equal_brute_force(spark, docs, none):
    long = prose(1, 300).split()
    items = [(1, " ".join(long[20:45]).upper()), (2, "short, TEXT"), (10, "nothing like it in any of the other texts here at all"), (3, None), (4, "..."), (None, "ha"), (5, "short text")]
    bench = spark.createDataFrame([(*r, "?") for r in items], "item_id bigint, text string, window string")
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wanted = [(i, w[k : k + 10]) for i, t in items if (w := fold(t)) for k in range(max(1, len(w) - 9))]
    for r in decontamination.find_contamination(docs, bench).collect():
        w, hit, names = fold(r.text), set(), set()
        for i, window in wanted:
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit |= {*range(k, k + len(window))}
                    names |= {str(i)} if i is not None else set()
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (len(w), len(hit), sorted(names))
        covered = [x for s in r.hits.spans for x in fold(r.text[s.start : s.end])]
        assert covered == [w[k] for k in sorted(hit)]
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & {1, 2, 3, 8, 9, 12} == set()
    assert decontamination.without_contaminated(docs, bench.filter("false")).count() == docs.count()
    assert decontamination.find_contamination(none, bench).count() == 0


def test_blocks_of_the_benchmark_add_up(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t, *_ in corpus() if t and i and i < 5], "item_id bigint, text string")
    whole = sorted(map(str, decontamination.find_contamination(docs, bench).select("doc_id", "hits").collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 150)
    assert sorted(map(str, decontamination.find_contamination(docs, bench).select("doc_id", "hits").collect())) == whole


def test_each_part_is_built_once(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 200)) for i in range(3)], "item_id bigint, text string")
    parts = decontamination.write_parts(decontamination.item_windows(bench), Scratch(spark), 200)
    assert len(parts) == 3
    built = []
    read = decontamination.read_part
    monkeypatch.setattr(decontamination, "read_part", lambda path: built.append(path) or read(path))
    texts = pa.array([prose(i, 200) for i in range(6)] + [None])
    hit = [[] for _ in range(7)]
    for part in parts:  # as a worker meets them: batch after batch of one part
        for _ in range(4):
            found = decontamination._scanner(part).func(texts).to_pylist()
        for runs, f in zip(hit, found):
            runs += f["runs"]
    assert built == parts
    assert [sum(r["b"] - r["a"] for r in runs) > 150 for runs in hit] == [True] * 3 + [False] * 4
    assert decontamination.write_parts(decontamination.item_windows(bench.filter("false")), Scratch(spark), 200) == []


def test_runs_of_several_scans_are_joined(spark):
    runs = [(3, 5, 30, 50), (0, 2, 0, 20), (5, 6, 50, 60), (4, 9, 40, 90), (12, 13, 120, 130), (1, 2, 10, 20)]
    frame = spark.createDataFrame([(runs,), ([],)], f"r array<{decontamination._RUN}>")
    got = [[tuple(x) for x in r[0]] for r in frame.select(decontamination.joined_runs(F.col("r"))).collect()]
    assert got == [[(0, 2, 0, 20), (3, 9, 30, 90), (12, 13, 120, 130)], []]


# --- near copies


def brute_classes(rows):
    def grams(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, len(links[i])))
    return Counter(out)


def test_classes_and_links_equal_all_pairs(spark, docs, none):
    got = near_duplicates.near_duplicates(docs).collect()
    assert Counter((r.key, r.class_id, r.n_links) for r in got) == brute_classes([r[:2] for r in corpus()])
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    # 15 stands for two texts that are no copies of each other
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, None, 15, 15, 16, 17])
    assert near_duplicates.near_duplicates(none).count() == 0


def test_a_large_group_in_many_cells(spark, monkeypatch):
    base = prose(50, 90).split()
    rows = []
    for i in range(60):
        own = list(base)
        own[(7 * i) % 90] = f"w{i}"
        rows.append((i, " ".join(own[: 90 - i % 9])))
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.key, r.class_id, r.n_links) for r in got) == brute_classes(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 300), (302, 302)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark)).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 300: 300, 301: 300} | {200 + i: 100 for i in range(50)}
    assert got == want


# --- lines


def brute_lines(rows, least):
    cut = {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone = {}, defaultdict(set)
    for at, (i, text) in enumerate(order):
        lines = text.split("\n")
        for a in range(len(lines)):
            n, b = 0, a
            while b < len(lines) and n < least:
                n += len(words_of(lines[b]))
                b += 1
            if n >= least:
                run = tuple(lines[a:b])
                if run in first:
                    gone[at] |= {*range(a, b)}
                else:
                    first[run] = at
    for at, (i, text) in enumerate(order):
        lines = text.split("\n")
        cut[(i, text)] = ("\n".join(x for k, x in enumerate(lines) if k not in gone[at]), len(lines), len(gone[at]))
    return cut


@pytest.mark.parametrize("least", [50, 7])
def test_later_copies_of_runs_go(docs, none, least):
    rows = [r[:2] for r in corpus() if not (r[0] == 15 and r[1] == prose(8, 80))]
    same = docs.filter(~(F.col("doc_id").eqNullSafe(15) & (F.col("text") == prose(8, 80))))
    got = line_dedup.dedup_lines(same.withColumnRenamed("text", "body").withColumn("text", F.col("body")), min_words=least).collect()
    want = brute_lines(rows, least)
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_lines, r.n_cut_lines) == (want[(r.doc_id, r.body)] if r.body is not None else (None, 0, 0))
    assert sum(r.n_cut_lines for r in got) > 5
    assert line_dedup.dedup_lines(none).count() == 0


def brute_whole_runs(texts, least):
    """Lines left of texts in order: gone is every line of a run that starts earlier too."""
    lines = [t.split("\n") for t in texts]
    starts, gone = [(d, i) for d, x in enumerate(lines) for i in range(len(x))], [set() for _ in texts]
    for k, (d, i) in enumerate(starts):
        for e, j in starts[:k]:
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if sum(len(words_of(x)) for x in lines[d][i : i + n]) >= least:
                gone[d] |= {*range(i, i + n)}
    return ["\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in range(len(texts))]


def test_whole_runs_go(spark):
    a, b = prose(70, 60), prose(71, 5)
    draw = random.Random(4)
    pool = [" ".join("w" * (n + 1) for _ in range(n)) for n in (0, 1, 3, 5, 8)]
    drawn = ["\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 25))) for _ in range(12)]
    for texts, least in (([f"{a}\n{b}\nx", f"y\n{a}\n{b}\nz", f"{b}\n{a}\n\n{b}"], 50), (drawn, 10)):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame, min_words=least, whole_runs=True).collect()}
        assert [got[i] for i in range(len(texts))] == brute_whole_runs(texts, least)
        if least == 50:
            assert got[1] == "y\nz"


# --- pages


def page(main: str, nav: str = "", foot: str = "") -> str:
    return f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><div>{nav}</div>{main}<div>{foot}</div></body></html>"


def test_declared_articles():
    html = (
        '<!DOCTYPE html><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div><!-- <p>no</p> -->'
        '<article><h1>A &amp; B</h1><p>one\n <b>two<i>three</i><br>four<p>five&nbsp;six</p><div class="share">S</div><form>f</form>'
        '<ul><li>x<li>y</ul><p title="a>b">last</p></article><section id="comments"><p>hi</p></section><aside>side</aside><footer>end'
    )
    found = html_extraction.blocks(html)
    assert html_extraction.assemble(found, set()) == "A & B\none twothree four\nfive six\nx\ny\nlast"


@pytest.mark.parametrize(
    "wrap",
    [
        '<body class="has-sidebar">{}</body>', '<html class="no-comments"><body class="sticky-header" id="menu">{}</body></html>', '<div id="page" class="no-comments">{}</div>',
        "<body><form action='/'><div>{}</div></form></body>", '<body class="has-sidebar"><form><div class="with-menu">{}</div></form></body>',
    ],
)
def test_names_of_wrappers_drop_nothing(wrap):
    text = lambda inner: html_extraction.assemble(html_extraction.blocks(wrap.format(inner)), set())
    story, rest = prose(1, 40), '<nav>n</nav><div class="related"><article>card</article></div><div class="comments"><article class="comment">c</article></div>'
    for tag in ("article", "main"):
        assert text(f"{rest}<{tag}><p>{story}</p><div class='share'>s</div><form>f</form></{tag}>{rest}") == story
    assert text(f"<nav>n</nav><article class='post with-sidebar'><p>{story}</p></article><div class='share'>s</div>") == story
    assert text(f"<main><h1>Title</h1><div class='has-sidebar'><article>{story}</article></div></main>") == f"Title\n{story}"
    assert text(f"<nav>n</nav><div><p>{story}</p></div><div class='share'>s</div>") == story


def test_shared_runs_of_a_host_go(spark):
    nav, foot = "Home News Sport Weather Travel Contact", "All rights reserved by the example company of nowhere"
    rows = [(i, f"http://h.example/{i}", page(f"<p>{prose(i, 30)}</p>", nav, foot)) for i in range(5)]
    rows += [(10, "http://other.example/", page(f"<p>{prose(3, 30)}</p>", nav, foot)), (11, None, None), (12, "http://[", ""), (13, "http://h.example/0", rows[0][2])]
    rows += [(14, "http://h.example/a", page("<article><p>" + prose(1, 30) + "</p></article>", nav, foot))]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id bigint, url string, html string, host string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    # page 1 has its paragraph as an article on page 14, which is protected there and no part of the stream
    assert all(got[i] == prose(i, 30) for i in range(5)) and got[13] == prose(0, 30) and got[14] == prose(1, 30)
    assert got[10] == "\n".join([nav, prose(3, 30), foot]) and got[11] == got[12] == ""
    assert html_extraction.extract(pages.filter("false")).count() == 0


def test_near_copied_open_pages_stay(spark):
    nav, foot = "Home News Sport Weather Travel Contact", "All rights reserved by the example company of nowhere"
    told = lambda i, ad: page(f"<div>{prose(i, 120)} {ad}</div>", nav, foot)
    rows = [(i, "http://h.example/", told(i, "x")) for i in range(8)] + [(8, "http://h.example/", told(0, "y"))]
    # four near copies beside others, a host of two near copies, a host of nothing else
    rows += [(10 + i, "http://h.example/", told(20, f"ad{i}")) for i in range(4)]
    rows += [(20 + i, "http://two.example/", told(21, f"ad{i}")) for i in range(2)]
    rows += [(30 + i, "http://all.example/", told(22, f"ad{i}")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert all(got[i] == f"{prose(i, 120)} x" for i in range(8)) and got[8] == f"{prose(0, 120)} y"
    assert all(got[10 + i] == f"{prose(20, 120)} ad{i}" for i in range(4))
    assert all(prose(n, 120) in got[i] for n, ids in ((21, (20, 21)), (22, range(30, 35))) for i in ids)


def test_ranks_tell_equal_prefixes():
    draw = random.Random(2)
    streams = [[[draw.choice("ab") for _ in range(draw.randrange(0, 9))] for _ in range(4)] for _ in range(60)]
    named = {}
    for s in streams:
        flat = [t for block in s if block for t in (*block, "\n")]
        got = html_extraction.ranks(s).tolist()
        want = [tuple(flat[i : i + html_extraction.DEPTH]) for i in range(max(1, len(flat) - html_extraction.DEPTH + 1))] if flat else []
        assert len(got) == len(want)
        for name, prefix in zip(got, want):
            assert named.setdefault(prefix, name) == name
    assert len(set(named.values())) == len(named)


def test_record_format():
    data = warc.record(7, "http://x", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\nabc\r\n\r\n") and warc.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))
    assert struct.unpack("<I", brute_ids("", 1))[0] == 1


def test_notices_that_a_host_repeats_inside_articles_go(spark):
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice = "We use small files on this site , accept them all to go on"
    page = lambda *inner: "<html><body><nav>Home</nav><article>" + "".join(f"<p>{x}</p>" for x in inner) + "</article></body></html>"
    rows, want = [], {}

    def add(host, blocks, kept):
        n = len(rows)
        rows.append((n, f"http://{host}/{n}", page(*blocks)))
        want[n] = "\n".join(kept)

    for _ in range(6):  # the notice with its heading, in the midst of stories
        a, b = prose(30), prose(20)
        add("news", [a, "Notice", notice, b], [a, b])
    quoted = prose(12)
    for i in range(9):  # what a third of the pages quote stays, and so does a notice with words of its own
        a = prose(25)
        inner = [a, quoted] if i < 3 else [a, f"{notice} {prose(2)}"]
        add("quotes", inner, inner)
    same = [prose(40), prose(15)]
    for i in range(5):  # near copies of one story, and copies of a page
        add("mirror", [*same, f"printed {i}"], [*same, f"printed {i}"])
        add("copy", same, same)
    for _ in range(2):  # too few pages to tell
        a = prose(20)
        add("small", [a, notice], [a, notice])
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want
