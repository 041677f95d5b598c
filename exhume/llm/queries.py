"""The registered queries: each operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exhume.llm import (
    decontamination,
    html_extraction,
    language_id,
    line_dedup,
    near_duplicates,
    packing,
    quality_classifier,
    quality_rules,
    resampling,
    simhash,
    spelling,
    token_files,
    warc,
)
from exhume.llm.text_stats import STOP_WORDS
from exhume.llm.tokens import vocabulary
from exhume.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def part_of(n: int):
    """Remainder that splits documents into learning and held-out rows; -1 (to learn from) without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"stats.{c}" for c in counts], "base_failed", "kept")


def _rule_sql(rule: quality_rules.Rule) -> str:
    value = rule.top if rule.bottom is None else f"(CASE WHEN {rule.bottom} > 0 THEN {rule.top} / {rule.bottom} ELSE 0 END)"
    tests = [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    return f"(n_words < {rule.from_words} OR ({' AND '.join(tests)}))"


ORACLES["op1_quality_rules"] = rf"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS p, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g
  FROM cut WHERE len(w) >= 5),
twice AS (SELECT r, p FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
hit AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, range(5) x(k) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop
  FROM cut LEFT JOIN hit USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(_rule_sql(r) for r in quality_rules.RULES)} AS kept
FROM judged
"""


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # features are read by the fit and by the scoring; they are a few numbers per document
    featured = Scratch(spark).write(quality_classifier.with_features(docs).drop("text").withColumn("held_out", part_of(5) == 0))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    model = quality_classifier.fit(featured.filter(~F.col("held_out")).join(labels, "doc_id"))
    return quality_classifier.score(featured, model).select("doc_id", "held_out", "score", "predicted")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = token_files.write_corpus(docs, Scratch(spark).path(), vocabulary())
    read = token_files.read_documents(index, checksums=True).join(token_files.global_starts(index), "file")
    return read.select(F.col("key").alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontamination.find_contamination(docs, items)
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op6_decontamination"] = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, item, i, grams.n FROM grams JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, range(10) x(k) WHERE k < n GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", part_of(4) == 2)
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select(F.col("key").alias("doc_id"), "class_id", "n_links")


ORACLES["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS (
  SELECT a.r AS u, b.r AS v FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r JOIN sizes s ON s.r = a.r JOIN sizes t ON t.r = b.r
  GROUP BY a.r, b.r, s.n, t.n HAVING 5 * count(*) >= 4 * (s.n + t.n - count(*))),
reach(u, v) AS (SELECT r, r FROM docs UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT d.doc_id, min(e.doc_id) AS class_id, (SELECT count(*) FROM links WHERE links.u = d.r) AS n_links
FROM docs d JOIN reach ON reach.u = d.r JOIN docs e ON e.r = reach.v GROUP BY d.r, d.doc_id
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op10_line_dedup"] = rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs WHERE text IS NOT NULL),
lines AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM cut),
summed AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM lines),
runs AS (
  SELECT a.r, a.i, min(b.i) AS j FROM summed a JOIN summed b ON a.r = b.r AND b.i >= a.i AND b.upto >= a.upto - a.n + {line_dedup.MIN_WORDS}
  GROUP BY a.r, a.i),
named AS (SELECT runs.r, runs.i, j, string_agg(t, chr(10) ORDER BY l.i) AS g FROM runs JOIN lines l ON l.r = runs.r AND l.i BETWEEN runs.i AND j GROUP BY runs.r, runs.i, j),
later AS (SELECT r, i, j FROM named QUALIFY row_number() OVER (PARTITION BY g ORDER BY r, i) > 1),
gone AS (SELECT DISTINCT l.r, l.i FROM lines l JOIN later k ON l.r = k.r AND l.i BETWEEN k.i AND k.j),
kept AS (
  SELECT r, count(*) AS n_lines, count(gone.r) AS n_cut_lines, string_agg(t, chr(10) ORDER BY i) FILTER (WHERE gone.r IS NULL) AS t
  FROM lines LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_cut_lines, 0)::BIGINT AS n_cut_lines
FROM docs LEFT JOIN kept USING (r)
"""


@query
def line_dedup_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 10 by maximal runs: all lines of a repeated run go, also those behind its last window of the fewest words."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_runs=True)


# the windows forward from each line and back from each line together cover every maximal run
ORACLES["line_dedup_whole_runs"] = ORACLES["op10_line_dedup"].replace("\n  GROUP BY a.r, a.i),", f"""
  GROUP BY a.r, a.i
  UNION SELECT b.r, max(a.i) AS i, b.i AS j FROM summed a JOIN summed b ON a.r = b.r AND b.i >= a.i AND b.upto >= a.upto - a.n + {line_dedup.MIN_WORDS}
  GROUP BY b.r, b.i),""")


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark).path())
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc"] = """
WITH page AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM page WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM page LEFT JOIN firsts USING (h)
"""


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", html_extraction.text_length(F.col("text")).alias("n_chars"))


@query
def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return joined.select(F.col("key").alias("doc_id"), name, F.col("component").alias("component_id"))


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


# CRC-32 of the bytes of distinct texts: the remainders of all bytes come from the polynomial, and a fold goes through the bytes
_CRC = """
crc_step AS (
  SELECT list(r ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
    FROM range(256) x(b))),
crc_bytes AS (SELECT t, hex(encode(t)) AS h FROM to_hash),
crcs AS (
  SELECT t, xor(list_reduce([4294967295] || [('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(h) // 2 + 1)],
    lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM crc_bytes, crc_step)"""

ORACLES["op12_target_resampling"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
found AS (SELECT r, unnest(w) AS t FROM docs),
wanted AS (SELECT unnest({_WORDS}) AS t FROM benchmark),
to_hash AS (SELECT t FROM found UNION SELECT t FROM wanted),{_CRC},
s AS (SELECT crc % 10000 AS b, count(*) AS n FROM found JOIN crcs USING (t) GROUP BY b),
t AS (SELECT crc % 10000 AS b, count(*) AS n FROM wanted JOIN crcs USING (t) GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
  FROM range(10000) x(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
means AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM found JOIN crcs USING (t) JOIN gain ON crc % 10000 = b GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM docs LEFT JOIN means USING (r)),
ranks AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranks USING (r)
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id || ':' || w AS t, w, n FROM (
    SELECT doc_id, w, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL)),
to_hash AS (SELECT DISTINCT t FROM runs),{_CRC},
words AS (
  SELECT CASE WHEN crc % 97 = 0 THEN w[:crc % length(w)] || w[crc % length(w) + 2:] ELSE w END AS word, sum(n)::BIGINT AS n
  FROM runs JOIN crcs USING (t) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS less FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
judged AS (
  SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
led(word, root, next) AS (
  SELECT word, word, form FROM judged UNION ALL SELECT led.word, led.next, judged.form FROM led JOIN judged ON judged.word = led.next)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, root FROM led WHERE next IS NULL) USING (word)
"""
