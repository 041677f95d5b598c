"""Checks for block hashing, alignment, byte and bit comparison, fingerprints and carving scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.checks.fixtures import check, view, with_views
from exhume.checks.text_search import F1, PRF
from exhume.functions.values import hamming, quality_label
from exhume.operators import byte_blocks as BB
from exhume.operators import byte_compare as BC
from exhume.operators.fingerprint import fingerprint64, image_lowfreq, nearest_original, select_original
from exhume.operators.ordered import islands, merge_intervals
from exhume.plans import carving
from exhume.session import stage

BLOCK = 64  # shift of the second carved variant, so that its blocks line up again
HEX = "(strpos('0123456789ABCDEF', substr({0}, 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({0}, 2, 1)) - 1"


def chain(pairs: str) -> str:
    """Oracle steps from ``pairs(pair, oh, ch)`` (hex texts) to block statistics and byte comparison."""
    return f""",
{pairs},
oblk AS (SELECT pair, i AS idx, i * {BLOCK} AS off, substr(oh, CAST(i * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK}) AS h FROM (SELECT pair, oh, unnest(range(0, CAST(ceil(length(oh) / {2 * BLOCK}.0) AS BIGINT))) AS i FROM pairs)),
cblk AS (SELECT pair, i AS idx, i * {BLOCK} AS off, substr(ch, CAST(i * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK}) AS h FROM (SELECT pair, ch, unnest(range(0, CAST(ceil(length(ch) / {2 * BLOCK}.0) AS BIGINT))) AS i FROM pairs)),
cand AS (SELECT c.pair, o.off - c.off AS d, c.idx AS ci, o.idx AS oi, o.off AS ooff, length(h) // 2 AS size FROM cblk c JOIN oblk o USING (pair, h)),
vote AS (SELECT pair, d AS "offset", votes FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY votes DESC, f) AS r FROM
  (SELECT pair, d, count(*) AS votes, min(ci * 10000000 + oi) AS f FROM cand GROUP BY pair, d)) WHERE r = 1),
aligned AS (SELECT cand.* FROM cand JOIN vote ON cand.pair = vote.pair AND cand.d = vote."offset"),
runs AS (SELECT pair, max(n) AS longest_run_blocks FROM (SELECT pair, count(*) AS n FROM (SELECT pair, ci - row_number() OVER (PARTITION BY pair ORDER BY ci) AS g FROM aligned) GROUP BY pair, g) GROUP BY pair),
segs AS (SELECT pair, max(ooff + size) - min(ooff) AS n FROM (SELECT *, oi - row_number() OVER (PARTITION BY pair ORDER BY oi) AS g FROM aligned) GROUP BY pair, g),
cover AS (SELECT pair, CAST(sum(n) AS BIGINT) AS covered_bytes, max(n) AS longest_run_bytes FROM segs GROUP BY pair),
stats AS (SELECT p.pair, length(oh) // 2 AS o_bytes, coalesce(ob.n, 0) AS original_blocks, coalesce(cb.n, 0) AS carved_blocks, coalesce("offset", 0) AS "offset", coalesce(votes, 0) AS votes,
    coalesce(k.n, 0) AS candidates, coalesce(a.n, 0) AS aligned_matches, coalesce(a.nc, 0) AS matched_carved_blocks, coalesce(a.no, 0) AS matched_orig_blocks,
    coalesce(longest_run_blocks, 0) AS longest_run_blocks, coalesce(covered_bytes, 0) AS covered_bytes, coalesce(longest_run_bytes, 0) AS longest_run_bytes
  FROM pairs p LEFT JOIN (SELECT pair, count(*) AS n FROM oblk GROUP BY pair) ob USING (pair) LEFT JOIN (SELECT pair, count(*) AS n FROM cblk GROUP BY pair) cb USING (pair)
  LEFT JOIN vote USING (pair) LEFT JOIN (SELECT pair, count(*) AS n FROM cand GROUP BY pair) k USING (pair)
  LEFT JOIN (SELECT pair, count(*) AS n, count(DISTINCT ci) AS nc, count(DISTINCT oi) AS no FROM aligned GROUP BY pair) a USING (pair) LEFT JOIN runs USING (pair) LEFT JOIN cover USING (pair)),
obyte AS MATERIALIZED (SELECT pair, unnest(regexp_extract_all(oh, '..')) AS b, unnest(range(0, length(oh) // 2)) AS i FROM pairs),
cbyte AS MATERIALIZED (SELECT pair, unnest(regexp_extract_all(ch, '..')) AS b, unnest(range(0, length(ch) // 2)) AS i FROM pairs),
modes AS (SELECT DISTINCT pair, o AS "offset" FROM (SELECT pair, 0 AS o FROM stats UNION ALL SELECT pair, "offset" FROM stats)),
shifted AS MATERIALIZED (SELECT m.pair, m."offset", o.i - greatest(m."offset", 0) AS rel, o.i - m."offset" AS i, o.b AS a FROM modes m JOIN obyte o USING (pair)),
cells AS MATERIALIZED (SELECT s.pair, s."offset", s.rel, s.a, c.b AS b FROM shifted s JOIN cbyte c ON c.pair = s.pair AND c.i = s.i),
eqruns AS (SELECT pair, "offset", max(n) AS longest_equal_run FROM (SELECT pair, "offset", count(*) AS n FROM
  (SELECT pair, "offset", rel - row_number() OVER (PARTITION BY pair, "offset" ORDER BY rel) AS g FROM cells WHERE a = b) GROUP BY pair, "offset", g) GROUP BY pair, "offset"),
diffs AS (SELECT pair, "offset", count(*) AS n, min(rel) AS first, CAST(sum(bit_count(xor({HEX.format('a')}, {HEX.format('b')}))) AS BIGINT) AS bits FROM cells WHERE a <> b GROUP BY ALL),
tails AS (SELECT m.pair, m."offset", length(oh) // 2 AS o_bytes, length(ch) // 2 AS c_bytes, greatest(length(oh) // 2 - greatest(m."offset", 0), 0) AS ot, greatest(length(ch) // 2 - greatest(-m."offset", 0), 0) AS ct FROM modes m JOIN pairs USING (pair)),
compared AS (SELECT *, 1.0::DOUBLE - CASE WHEN total_bytes = 0 THEN 0.0 ELSE diff_bytes / total_bytes END AS byte_similarity, greatest("offset", 0) + first_diff AS first_diff_orig, greatest(-"offset", 0) + first_diff AS first_diff_carved,
    CASE WHEN overlap > 0 THEN diff_bits / (8 * overlap) END AS bit_error_rate FROM
  (SELECT t.pair, t."offset", t.o_bytes, t.c_bytes, greatest(ot, ct) AS total_bytes, least(ot, ct) AS overlap, coalesce(d.n, 0) + greatest(ot, ct) - least(ot, ct) AS diff_bytes, coalesce(d.bits, 0) AS diff_bits,
    coalesce(d.first, CASE WHEN ot <> ct THEN least(ot, ct) END) AS first_diff, coalesce(longest_equal_run, 0) AS longest_equal_run
  FROM tails t LEFT JOIN diffs d USING (pair, "offset") LEFT JOIN eqruns USING (pair, "offset")))"""


DOCS = with_views("carved") + chain("pairs AS (SELECT file_id AS pair, hex(orig_text) AS oh, hex(carved_text) AS ch FROM carved)")
RATES = """CASE WHEN carved_blocks = 0 THEN 0.0 ELSE matched_carved_blocks / carved_blocks END AS block_match_rate,
  CASE WHEN original_blocks = 0 THEN 0.0 ELSE matched_orig_blocks / original_blocks END AS recall_blocks,
  CASE WHEN o_bytes = 0 THEN 0.0 ELSE longest_run_bytes / o_bytes END AS run_coverage"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = view(spark, d, "carved")
    orig = docs.select(F.col("file_id").alias("pair"), F.encode("orig_text", "UTF-8").alias("content"))
    return orig, docs.select(F.col("file_id").alias("pair"), F.encode("carved_text", "UTF-8").alias("content"))


def blocks(spark, d):
    orig, carved = sides(spark, d)
    return BB.byte_blocks(orig, ["pair"], block_size=BLOCK), BB.byte_blocks(carved, ["pair"], block_size=BLOCK)


def voted(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of both sides, and their votes; each is read several times and therefore written once."""
    o, c = (stage(BB.named_blocks(x, ["pair"])) for x in blocks(spark, d))
    return o, c, stage(BB.alignment_vote(o, c, ["pair"], BLOCK))


@check("byte_blocks", DOCS + """ SELECT pair, idx AS "index", off AS "offset", length(h) // 2 AS size, upper(sha256(unhex(h))) AS hash FROM oblk""")
def _(spark, d):
    return blocks(spark, d)[0].withColumn("hash", F.hex("hash"))


@check("block_hash_join", DOCS + """ SELECT pair, length(h) // 2 AS size, upper(sha256(unhex(h))) AS hash, count(DISTINCT oi) AS o_blocks, count(DISTINCT ci) AS c_blocks
  FROM cand JOIN (SELECT pair, idx, h FROM oblk) b USING (pair) WHERE b.idx = cand.oi GROUP BY ALL""")
def _(spark, d):
    return BB.block_hash_join(*blocks(spark, d), ["pair"]).withColumn("hash", F.hex("hash"))


@check("alignment_vote", DOCS + """ SELECT vote.*, k.n AS candidates FROM vote JOIN (SELECT pair, count(*) AS n FROM cand GROUP BY pair) k USING (pair)""")
def _(spark, d):
    return voted(spark, d)[2]


@check("aligned_match_stats", DOCS + f" SELECT *, {RATES} FROM stats")
def _(spark, d):
    orig, _carved = sides(spark, d)
    sized = orig.select("pair", F.octet_length("content").cast("bigint").alias("o_bytes"))
    return BB.aligned_match_stats(sized, *blocks(spark, d), ["pair"], BLOCK)


@check("longest_block_run", DOCS + " SELECT * FROM runs")
def _(spark, d):
    aligned = BB.aligned_matches(*voted(spark, d), ["pair"])
    return islands(aligned, ["pair"], "c_index", width=16).groupBy("pair").agg(
        F.max(F.col("hi") - F.col("lo") + 1).alias("longest_run_blocks")
    )


@check("merge_intervals", """
WITH spans AS (SELECT l_suppkey AS k, l_partkey * 10 AS s, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
marked AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM spans),
grouped AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY s, e) AS g FROM marked)
SELECT k, min(s) AS lo, max(e) AS hi FROM grouped GROUP BY k, g""")
def _(spark, d):
    spans = view(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 10).alias("s"),
        (F.col("l_partkey") * 10 + F.col("l_quantity").cast("bigint")).alias("e"),
    )
    return merge_intervals(spans, ["k"], "s", "e", width=500)


@check("byte_compare_lockstep", DOCS + """ SELECT * FROM compared WHERE "offset" = 0""")
def _(spark, d):
    zero = F.lit(0).cast("bigint").alias("offset")
    orig, carved = sides(spark, d)
    return BC.byte_compare(orig.select("*", zero), carved.select("*", zero), ["pair", "offset"], chunk=4096)


@check("byte_compare_aligned", DOCS + """ SELECT compared.* FROM compared JOIN stats USING (pair, "offset")""")
def _(spark, d):
    orig, carved = sides(spark, d)
    vote = voted(spark, d)[2].select("pair", "offset")
    shifted = lambda df: df.join(vote, "pair", "left").fillna(0, ["offset"])
    return BC.byte_compare(shifted(orig), shifted(carved), ["pair", "offset"])


@check("bit_error_rate", DOCS + """ SELECT pair, diff_bits, 8 * overlap AS total_bits, bit_error_rate FROM compared JOIN stats USING (pair, "offset")""")
def _(spark, d):
    orig, carved = sides(spark, d)
    vote = voted(spark, d)[2].select("pair", "offset")
    shifted = lambda df: df.join(vote, "pair", "left").fillna(0, ["offset"])
    return BC.byte_compare(shifted(orig), shifted(carved), ["pair", "offset"]).select(
        "pair", "diff_bits", (8 * F.col("overlap")).alias("total_bits"), "bit_error_rate"
    )


LOCK = DOCS + f""",
full_cells AS (SELECT coalesce(o.pair, c.pair) AS pair, coalesce(o.i, c.i) AS i, c.b AS a, o.b AS b FROM obyte o FULL JOIN cbyte c ON o.pair = c.pair AND o.i = c.i),
vals AS (SELECT *, a IS NOT DISTINCT FROM b AS same, coalesce({HEX.format('a')}, 0) AS va, coalesce({HEX.format('b')}, 0) AS vb FROM full_cells),
bad_bits AS (SELECT pair, pos FROM (SELECT pair, i * 8 + k AS pos, (xor(va, vb) >> (7 - k)) & 1 AS bad FROM (SELECT * FROM vals WHERE va <> vb), range(0, 8) t(k)) WHERE bad = 1),
sizes AS (SELECT pair, length(ch) // 2 AS size_a, length(oh) // 2 AS size_b, greatest(length(ch), length(oh)) // 2 AS m FROM pairs),
ends AS (SELECT pair, pos FROM bad_bits UNION ALL SELECT pair, -1 FROM sizes UNION ALL SELECT pair, m * 8 FROM sizes),
bit_runs AS (SELECT pair, max(gap) AS longest_equal_bits FROM (SELECT pair, pos - lag(pos) OVER (PARTITION BY pair ORDER BY pos) - 1 AS gap FROM ends) GROUP BY pair),
bit_sums AS (SELECT pair, count(*) AS diff_bits, min(pos) AS first_diff_bit FROM bad_bits GROUP BY pair),
byte_sums AS (SELECT pair, count(*) FILTER (NOT same) AS diff_bytes, min(i) FILTER (NOT same) AS first_diff, count(*) FILTER (same) AS recovered_bytes FROM vals GROUP BY pair),
byte_runs AS (SELECT pair, max(n) AS longest_equal_bytes FROM (SELECT pair, count(*) AS n FROM (SELECT pair, i - row_number() OVER (PARTITION BY pair ORDER BY i) AS g FROM vals WHERE same) GROUP BY pair, g) GROUP BY pair),
blk AS (SELECT pair, i // {BLOCK} AS k, bool_and(va = vb) AS eq, bool_and(same) AS same FROM vals GROUP BY ALL),
blk_sums AS (SELECT pair, count(*) AS total_blocks, count(*) FILTER (eq) AS matching_blocks, min(k) FILTER (NOT eq) AS first_mismatch_block, count(*) FILTER (same) AS recovered_blocks FROM blk GROUP BY pair),
blk_runs AS (SELECT pair, max(n) AS longest_equal_blocks FROM (SELECT pair, count(*) AS n FROM (SELECT pair, k - row_number() OVER (PARTITION BY pair ORDER BY k) AS g FROM blk WHERE eq) GROUP BY pair, g) GROUP BY pair),
lock AS (SELECT s.pair, size_a, size_b, m, coalesce(diff_bytes, 0) AS diff_bytes, first_diff, coalesce(longest_equal_bytes, 0) AS longest_equal_bytes, coalesce(diff_bits, 0) AS diff_bits, first_diff_bit, longest_equal_bits,
   coalesce(total_blocks, 0) AS total_blocks, coalesce(matching_blocks, 0) AS matching_blocks, first_mismatch_block, coalesce(longest_equal_blocks, 0) AS longest_equal_blocks,
   coalesce(recovered_blocks, 0) AS recovered_blocks, coalesce(recovered_bytes, 0) AS recovered_bytes
  FROM sizes s LEFT JOIN byte_sums USING (pair) LEFT JOIN byte_runs USING (pair) LEFT JOIN bit_sums USING (pair) LEFT JOIN bit_runs USING (pair) LEFT JOIN blk_sums USING (pair) LEFT JOIN blk_runs USING (pair))"""


def lockstep(spark, d):
    orig, carved = sides(spark, d)
    return BC.lockstep_compare(carved, orig, ["pair"], block=BLOCK, chunk=2048)


@check("lockstep_bits", LOCK + """ SELECT pair, size_a, size_b, diff_bytes, first_diff, longest_equal_bytes, diff_bits, first_diff_bit, longest_equal_bits,
  1.0::DOUBLE - diff_bytes / m AS byte_similarity, diff_bits / (m * 8) AS bit_error_rate, longest_equal_bits / (m * 8) AS longest_equal_bits_fraction FROM lock""")
def _(spark, d):
    return lockstep(spark, d).select(
        "pair", "size_a", "size_b", "diff_bytes", "first_diff", "longest_equal_bytes", "diff_bits", "first_diff_bit",
        "longest_equal_bits", "byte_similarity", "bit_error_rate", "longest_equal_bits_fraction",
    )


@check("lockstep_blocks", LOCK + """ SELECT pair, total_blocks, matching_blocks, first_mismatch_block, longest_equal_blocks,
  matching_blocks / total_blocks AS block_match_rate, longest_equal_blocks / total_blocks AS longest_equal_blocks_fraction FROM lock""")
def _(spark, d):
    return lockstep(spark, d).select(
        "pair", "total_blocks", "matching_blocks", "first_mismatch_block", "longest_equal_blocks", "block_match_rate",
        "longest_equal_blocks_fraction",
    )


@check("recovery_percent", LOCK + f""" SELECT pair, recovered_bytes, recovered_blocks, CASE WHEN size_b = 0 THEN 0.0 ELSE recovered_bytes / size_b END * 100 AS byte_recovery_pct,
  CASE WHEN size_b // {BLOCK} = 0 THEN 0.0 ELSE recovered_blocks / (size_b // {BLOCK}) END * 100 AS block_recovery_pct FROM lock""")
def _(spark, d):
    return lockstep(spark, d).select("pair", "recovered_bytes", "recovered_blocks", "byte_recovery_pct", "block_recovery_pct")


@check("longest_equal_run", DOCS + """ SELECT pair, longest_equal_run FROM compared WHERE "offset" = 0""")
def _(spark, d):
    """Chunks of 100 bytes, so most runs cross chunk borders."""
    zero = F.lit(0).cast("bigint").alias("offset")
    orig, carved = sides(spark, d)
    done = BC.byte_compare(orig.select("*", zero), carved.select("*", zero), ["pair", "offset"], chunk=100)
    return done.select("pair", "longest_equal_run")


@check("quality_label", DOCS + """ SELECT pair, CASE WHEN pair % 6 = 0 THEN 'Failed to display' WHEN byte_similarity < 0.1 THEN 'Incomplete – major flaws'
  WHEN byte_similarity < 0.5 THEN 'Usable – minor flaws' ELSE 'Complete no flaws' END AS label FROM compared WHERE "offset" = 0""")
def _(spark, d):
    zero = F.lit(0).cast("bigint").alias("offset")
    orig, carved = sides(spark, d)
    done = BC.byte_compare(orig.select("*", zero), carved.select("*", zero), ["pair", "offset"])
    return done.select("pair", quality_label(F.col("pair") % 6 != 0, F.col("byte_similarity")).alias("label"))


FP = """WITH vals AS (SELECT vec_id, label, embedding FROM embeddings),
med AS (SELECT vec_id, median(CAST(v AS DOUBLE)) AS m FROM (SELECT vec_id, unnest(embedding[2:]) AS v FROM vals) GROUP BY vec_id),
cells AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM vals),
fp AS (SELECT vec_id, label, CAST(sum(CASE WHEN CAST(v AS DOUBLE) > m THEN CASE WHEN i = 0 THEN -9223372036854775808::HUGEINT ELSE CAST(1 AS HUGEINT) << (63 - i) END ELSE 0 END) AS BIGINT) AS hash
  FROM cells JOIN med USING (vec_id) JOIN vals USING (vec_id) GROUP BY vec_id, label),
sub AS (SELECT concat('L', CAST(label AS VARCHAR)) AS scope, vec_id AS sub_id, xor(hash, vec_id % 8) AS hash FROM fp),
gt AS (SELECT concat('L', CAST(label AS VARCHAR)) AS scope, vec_id AS gt_id, hash FROM fp),
near AS (SELECT * FROM (SELECT s.scope, sub_id, gt_id, gt_id AS gt_pos, CAST(bit_count(xor(s.hash, g.hash)) AS BIGINT) AS dist, row_number() OVER (PARTITION BY sub_id ORDER BY bit_count(xor(s.hash, g.hash)), gt_id) AS rank
  FROM sub s JOIN gt g USING (scope)) WHERE rank <= 3)"""


def fingerprints(spark, d):
    fp = view(spark, d, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("scope"), "vec_id", fingerprint64(F.col("embedding")).alias("hash")
    )
    # every vector is an original and, with some bits changed, a submission
    sub = fp.withColumn("hash", F.col("hash").bitwiseXOR(F.col("vec_id") % 8)).withColumnRenamed("vec_id", "sub_id")
    return sub, fp.withColumn("gt_pos", F.col("vec_id")).withColumnRenamed("vec_id", "gt_id")


@check("fingerprint64", FP + " SELECT vec_id, hash FROM fp")
def _(spark, d):
    return view(spark, d, "embeddings").select("vec_id", fingerprint64(F.col("embedding")).alias("hash"))


@check("image_fingerprint")
def _(spark, d):
    """Whole documents as grey images, 32 bytes a row, the last row filled up with zeros."""
    data = F.encode("text", "UTF-8")
    rows = F.ceil(F.octet_length(data) / 32).cast("int")
    image = F.struct(
        F.col("doc_id").cast("string").alias("origin"), rows.alias("height"), F.lit(32).alias("width"), F.lit(1).alias("nChannels"),
        F.rpad(data, rows * 32, F.lit(b"\x00")).alias("data"),
    )
    low = image_lowfreq(view(spark, d, "documents").select(image.alias("image")))
    return low.select(F.col("path").cast("bigint").alias("doc_id"), "decodes", fingerprint64(F.col("values")).alias("hash"))


@check("hamming", FP + " SELECT vec_id, CAST(bit_count(xor(hash, vec_id)) AS BIGINT) AS dist FROM fp")
def _(spark, d):
    fp = view(spark, d, "embeddings").select("vec_id", fingerprint64(F.col("embedding")).alias("hash"))
    return fp.select("vec_id", hamming(F.col("hash"), F.col("vec_id")).cast("bigint").alias("dist"))


@check("nearest_original", FP + " SELECT * FROM near")
def _(spark, d):
    return nearest_original(*fingerprints(spark, d), ["scope"], ["sub_id"], k=3)


SCORED = "SELECT *, ((sub_id + gt_id) % 17) / 16.0::DOUBLE AS similarity, ((sub_id * gt_id) % 11) / 10.0::DOUBLE AS recall_blocks FROM near"


@check("select_original", FP + f""", scored AS ({SCORED})
SELECT sub_id, gt_id, 'hybrid' AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY similarity DESC, dist, gt_pos) AS r FROM scored) WHERE r = 1
UNION ALL SELECT sub_id, gt_id, 'blocks' FROM (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY recall_blocks DESC, gt_pos) AS r FROM scored) WHERE r = 1
UNION ALL SELECT sub_id, gt_id, 'phash_first' FROM scored WHERE rank = 1""")
def _(spark, d):
    near = nearest_original(*fingerprints(spark, d), ["scope"], ["sub_id"], k=3)
    scored = near.withColumn("similarity", ((F.col("sub_id") + F.col("gt_id")) % 17) / F.lit(16.0)).withColumn(
        "recall_blocks", ((F.col("sub_id") * F.col("gt_id")) % 11) / F.lit(10.0)
    )
    picks = [
        select_original(scored, ["sub_id"], s).select("sub_id", "gt_id", F.lit(s).alias("strategy"))
        for s in ("hybrid", "blocks", "phash_first")
    ]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


CASES = with_views("carved") + """,
files AS (SELECT file_id, concat('carv-', lang) AS base_test_case, hex(orig_text) AS oh, hex(carved_text) AS ch, CASE WHEN file_id % 7 <> 0 THEN xor(file_id * 2654435761, n_chars) END AS hash,
  CASE WHEN file_id % 7 <> 0 THEN xor(xor(file_id * 2654435761, n_chars), file_id % 5) END AS shash, file_id % 6 <> 0 AS decodes FROM carved JOIN documents ON doc_id = file_id),
near AS (SELECT sub_id, gt_id FROM (SELECT s.file_id AS sub_id, g.file_id AS gt_id, row_number() OVER (PARTITION BY s.file_id ORDER BY bit_count(xor(s.shash, g.hash)), g.file_id) AS r
  FROM files s JOIN files g USING (base_test_case) WHERE s.shash IS NOT NULL AND g.hash IS NOT NULL) WHERE r = 1),
rest AS (SELECT * FROM files WHERE shash IS NULL),
pieces AS (SELECT file_id, base_test_case, substr(oh, CAST(i * 128 + 1 AS BIGINT), 128) AS h FROM (SELECT *, unnest(range(0, CAST(ceil(length(oh) / 128.0) AS BIGINT))) AS i FROM files)),
rpieces AS (SELECT file_id, base_test_case, substr(ch, CAST(i * 128 + 1 AS BIGINT), 128) AS h FROM (SELECT *, unnest(range(0, CAST(ceil(length(ch) / 128.0) AS BIGINT))) AS i FROM rest)),
shared AS (SELECT DISTINCT r.file_id AS sub_id, p.file_id AS gt_id FROM rpieces r JOIN pieces p USING (base_test_case, h)
  UNION SELECT r.file_id, f.first FROM rest r JOIN (SELECT base_test_case, min(file_id) AS first FROM files GROUP BY ALL) f USING (base_test_case))"""
RECALL = CASES + chain("pairs AS (SELECT sub_id * 1000000 + gt_id AS pair, o.oh, c.ch FROM shared JOIN files o ON o.file_id = gt_id JOIN files c ON c.file_id = sub_id)")
PICKED = RECALL + """, picked AS (SELECT sub_id, gt_id, 'phash' AS selected_by FROM near UNION ALL
  SELECT pair // 1000000, pair % 1000000, 'blocks' FROM (SELECT pair, row_number() OVER (PARTITION BY pair // 1000000 ORDER BY CASE WHEN original_blocks = 0 THEN 0 ELSE matched_orig_blocks / original_blocks END DESC, pair % 1000000) AS r FROM stats) WHERE r = 1)"""
CARVING = CASES.replace("WITH ", "WITH picked AS (SELECT * FROM (" + PICKED + " SELECT * FROM picked)),\n", 1) + chain(
    "pairs AS (SELECT sub_id AS pair, o.oh, c.ch FROM picked JOIN files o ON o.file_id = gt_id JOIN files c ON c.file_id = sub_id)"
) + """,
hits AS (SELECT f.base_test_case, 'tool' AS tool_used, p.sub_id, p.gt_id, p.selected_by, l.byte_similarity, a.byte_similarity AS aligned_byte_similarity, a.bit_error_rate, matched_orig_blocks,
    CASE WHEN NOT decodes THEN 'Failed to display' WHEN coalesce(a.byte_similarity, l.byte_similarity) < 0.1 THEN 'Incomplete – major flaws' WHEN coalesce(a.byte_similarity, l.byte_similarity) < 0.5 THEN 'Usable – minor flaws' ELSE 'Complete no flaws' END AS quality_label,
    decodes AND l.byte_similarity > 0.2 AS hit
  FROM picked p JOIN files f ON f.file_id = p.sub_id JOIN stats s ON s.pair = p.sub_id JOIN compared l ON l.pair = p.sub_id AND l."offset" = 0 JOIN compared a ON a.pair = p.sub_id AND a."offset" = s."offset")"""


def cases(spark, d):
    docs = view(spark, d, "carved").join(
        view(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", "n_chars"), "file_id"
    )
    base = F.concat(F.lit("carv-"), "lang").alias("base_test_case")
    own = F.when(F.col("file_id") % 7 != 0, (F.col("file_id") * 2654435761).bitwiseXOR(F.col("n_chars")))
    originals = docs.select(
        base, F.col("file_id").alias("gt_id"), F.col("file_id").alias("gt_pos"), F.encode("orig_text", "UTF-8").alias("content"), own.alias("hash")
    )
    subs = docs.select(
        base, F.lit("tool").alias("tool_used"), F.col("file_id").alias("sub_id"), F.encode("carved_text", "UTF-8").alias("content"),
        own.bitwiseXOR(F.col("file_id") % 5).alias("hash"), (F.col("file_id") % 6 != 0).alias("decodes"),
    )
    return subs, originals


@check("carving_details", CARVING + " SELECT * FROM hits")
def _(spark, d):
    return carving.carving_details(*cases(spark, d), block_size=BLOCK).select(
        "base_test_case", "tool_used", "sub_id", "gt_id", "selected_by", "byte_similarity", "aligned_byte_similarity", "bit_error_rate",
        "matched_orig_blocks", "quality_label", "hit",
    )


@check("carving_score", CARVING + f""",
counts AS (SELECT h.*, total_ground_truth_files, greatest(total_ground_truth_files - tp, 0) AS fn FROM (SELECT base_test_case, tool_used, count(*) AS total_submitted_files, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM hits GROUP BY ALL) h
  JOIN (SELECT base_test_case, count(*) AS total_ground_truth_files FROM files GROUP BY ALL) USING (base_test_case))
SELECT *, {F1} FROM (SELECT *, {PRF} FROM counts)""")
def _(spark, d):
    subs, originals = cases(spark, d)
    return carving.carving_score(carving.carving_details(subs, originals, block_size=BLOCK), originals)
