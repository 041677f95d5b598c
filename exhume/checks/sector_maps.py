"""Checks for sector ranges, partitions, unit sizes, ground-truth updates and substring joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from exhume.checks.fixtures import check, view, with_views
from exhume.functions import blocks as B
from exhume.functions.text import derive_case, parse_bool, resolve_suite, safe_file_name, strip_dup_suffix
from exhume.operators import contains as C
from exhume.operators import sectors as S
from exhume.session import stage

START = 63
SPANS = with_views("ranges") + """,
r AS (SELECT gt_pos, base_test_case, file_name, size, lo * 8 + 63 AS s1, (hi + 1) * 8 + 62 AS e1, hi * 8 + 200 AS s2, lo, hi FROM ranges),
spans AS (SELECT gt_pos, s1 AS s, e1 AS e FROM r UNION SELECT gt_pos, s2, s2 FROM r WHERE NOT (s2 BETWEEN s1 AND e1))"""


def parsed(spark, d):
    return view(spark, d, "ranges").withColumn("ranges", B.parse_ranges(F.col("sector_ranges")))


@check("parse_ranges", SPANS + " SELECT gt_pos, string_agg(concat(s, '-', e), ',' ORDER BY s, e) AS spans FROM spans GROUP BY gt_pos")
def _(spark, d):
    text = F.array_join(F.transform("ranges", lambda r: F.concat(r["s"].cast("string"), F.lit("-"), r["e"].cast("string"))), ",")
    return parsed(spark, d).select("gt_pos", text.alias("spans"))


@check("parse_ranges_endpoints", SPANS + """ SELECT gt_pos, string_agg(concat(s, '-', e), ',' ORDER BY s, e) AS spans FROM
  (SELECT gt_pos, s1 AS s, e1 AS e FROM r UNION SELECT gt_pos, s2, s2 FROM r WHERE s2 <> s1 AND s2 <> e1) GROUP BY gt_pos""")
def _(spark, d):
    ranges = B.parse_ranges_endpoints(F.col("sector_ranges"))
    text = F.array_join(F.transform(ranges, lambda r: F.concat(r["s"].cast("string"), F.lit("-"), r["e"].cast("string"))), ",")
    return view(spark, d, "ranges").select("gt_pos", text.alias("spans"))


@check("sectors_to_units", SPANS + """ SELECT gt_pos, count(DISTINCT u) AS n_units, min(u) AS first_unit, CAST(sum(DISTINCT u) AS BIGINT) AS unit_sum FROM
  (SELECT gt_pos, unnest(generate_series(CAST(floor((s - 100) / 4) AS BIGINT), CAST(floor((e - 100) / 4) AS BIGINT))) AS u FROM spans) GROUP BY gt_pos""")
def _(spark, d):
    units = B.sectors_to_units(F.col("ranges"), F.lit(100).cast("bigint"), F.lit(4).cast("bigint"))
    numbers = F.flatten(F.transform("_u", lambda r: F.sequence(r["s"], r["e"])))
    return parsed(spark, d).withColumn("_u", units).select(
        "gt_pos", B.range_count(F.col("_u")).alias("n_units"), B.first_block(F.col("_u")).alias("first_unit"),
        F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("unit_sum"),
    )


@check("relative_sectors", SPANS + f""" SELECT gt_pos, count(DISTINCT u) AS n, min(u) AS low, max(u) AS high FROM
  (SELECT gt_pos, unnest(generate_series(s - {START}, e - {START})) AS u FROM spans) GROUP BY gt_pos""")
def _(spark, d):
    rel = B.relative_sectors(F.col("ranges"), F.lit(START).cast("bigint"))
    return parsed(spark, d).withColumn("_r", rel).select(
        "gt_pos", B.range_count(F.col("_r")).alias("n"), F.col("_r")[0]["s"].alias("low"), F.element_at("_r", -1)["e"].alias("high")
    )


@check("fat_clusters", SPANS + """ SELECT gt_pos, 2 + min(u) - (32 + 2 * 200 + 32) // 8 AS first_cluster, 2 + max(u) - (32 + 2 * 200 + 32) // 8 AS last_cluster FROM
  (SELECT gt_pos, unnest(generate_series((s - 63) // 8, (e - 63) // 8)) AS u FROM spans) GROUP BY gt_pos""")
def _(spark, d):
    n = lambda v: F.lit(v).cast("bigint")
    data = B.fat_data_start(n(START), n(32), n(2), n(200), n(512), n(512))
    clusters = B.fat_clusters(B.sectors_to_units(F.col("ranges"), n(START), n(8)), data, n(START), n(8))
    return parsed(spark, d).withColumn("_c", clusters).select(
        "gt_pos", F.col("_c")[0]["s"].alias("first_cluster"), F.element_at("_c", -1)["e"].alias("last_cluster")
    )


@check("partition_totals", SPANS + """ SELECT gt_pos, CAST(sum(e - s + 1) AS BIGINT) AS sectors, any_value(CASE WHEN size <= 0 THEN 0 ELSE (size + 4095) // 4096 END) AS expected FROM spans JOIN r USING (gt_pos) GROUP BY gt_pos""")
def _(spark, d):
    return parsed(spark, d).select(
        "gt_pos", B.range_count(F.col("ranges")).alias("sectors"), B.expected_units(F.col("size"), F.lit(4096).cast("bigint")).alias("expected")
    )


PARTS = """, parts AS (SELECT concat('P', CAST(n_nationkey AS VARCHAR)) AS name, n_nationkey * 600 + 63 AS "start", n_nationkey * 600 + CASE WHEN n_nationkey % 4 = 0 THEN 600 ELSE 662 END AS "end" FROM nation)"""


def partitions(spark, d):
    """The same 25 partitions on every image."""
    key = F.col("k")
    cases = view(spark, d, "ranges").select("base_test_case").distinct()
    return cases.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint")))).select(
        "base_test_case", F.concat(F.lit("P"), key.cast("string")).alias("name"), (key * 600 + 63).alias("start"),
        (key * 600 + F.when(key % 4 == 0, 600).otherwise(662)).alias("end"),
    )


@check("sector_to_partition", SPANS + PARTS + """,
probes AS (SELECT gt_pos, s, e, unnest([s, e, (s + e) // 2]) AS x FROM spans),
hit AS (SELECT gt_pos, s, e, x, arg_min(name, "start") AS name FROM probes JOIN parts ON x BETWEEN "start" AND "end" GROUP BY ALL),
ends AS (SELECT sp.gt_pos, sp.s, sp.e, a.name AS na, b.name AS nb FROM spans sp LEFT JOIN hit a ON a.gt_pos = sp.gt_pos AND a.s = sp.s AND a.e = sp.e AND a.x = sp.s LEFT JOIN hit b ON b.gt_pos = sp.gt_pos AND b.s = sp.s AND b.e = sp.e AND b.x = sp.e),
touched AS (SELECT gt_pos, na AS name FROM ends WHERE na = nb UNION SELECT h.gt_pos, h.name FROM hit h JOIN ends USING (gt_pos, s, e) WHERE na IS DISTINCT FROM nb OR na IS NULL),
per AS (SELECT gt_pos, string_agg(DISTINCT name, '|' ORDER BY name) AS partitions, count(DISTINCT name) AS n FROM touched GROUP BY gt_pos)
SELECT r.gt_pos, coalesce(partitions, '') AS partitions, CASE coalesce(n, 0) WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'OK' ELSE 'CROSSES_PARTITIONS' END AS status FROM r LEFT JOIN per USING (gt_pos)""")
def _(spark, d):
    return S.sector_to_partition(parsed(spark, d), partitions(spark, d), ["base_test_case"]).select("gt_pos", "partitions", "status")


@check("pick_partition", SPANS + PARTS + """,
ext AS (SELECT gt_pos, min(s) AS lo, max(e) AS hi FROM spans GROUP BY gt_pos),
cand AS (SELECT gt_pos, name, "start", CASE WHEN hi <= "end" THEN 0 ELSE 1 END AS rank FROM ext JOIN parts ON lo BETWEEN "start" AND "end")
SELECT ext.gt_pos, arg_min("start", rank * 1000000 + "start") AS part_start, arg_min(name, rank * 1000000 + "start") AS part_name FROM ext LEFT JOIN cand USING (gt_pos) GROUP BY ext.gt_pos""")
def _(spark, d):
    return S.pick_partition(parsed(spark, d), partitions(spark, d), ["base_test_case"]).select("gt_pos", "part_start", "part_name")


FIT = SPANS + """,
cands AS (SELECT unnest([4096, 2048, 1024, 8192, 16384, 32768, 65536, 512]) AS u, unnest(range(0, 8)) AS rank),
spread AS (SELECT gt_pos, cands.u, CAST(floor((s - 63) / (cands.u / 512)) AS BIGINT) AS a, CAST(floor((e - 63) / (cands.u / 512)) AS BIGINT) AS b FROM spans, cands),
units AS (SELECT gt_pos, u, CAST(sum(greatest(0, b - greatest(a, coalesce(m + 1, a)) + 1)) AS BIGINT) AS n FROM
  (SELECT *, max(b) OVER (PARTITION BY gt_pos, u ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spread) GROUP BY ALL),
totals AS (SELECT gt_pos, CAST(sum(e - s + 1) AS BIGINT) AS total, any_value(size) AS size, {GCD} AS g FROM spans JOIN r USING (gt_pos) GROUP BY gt_pos),
aligned AS (SELECT gt_pos, u, max(CASE WHEN (s - 63) % (u // 512) <> 0 THEN 1 ELSE 0 END) AS mis FROM spans, cands GROUP BY ALL),
scored AS (SELECT gt_pos, u, rank, CASE WHEN n = (size + u - 1) // u THEN 0 ELSE 1 END AS differs, mis, greatest(0, n * (u // 512) - total) AS over, total, size, g FROM units JOIN totals USING (gt_pos) JOIN aligned USING (gt_pos, u) JOIN cands USING (u))"""
PLAIN_FIT = FIT.replace("{GCD}", "0")
LIST_GCD = "list_reduce(list(e - s + 1), lambda a, b: gcd(a, b))"


@check("infer_unit_size", PLAIN_FIT + " SELECT gt_pos, CAST(u AS BIGINT) AS unit_size FROM (SELECT *, row_number() OVER (PARTITION BY gt_pos ORDER BY differs, mis, over, rank) AS k FROM scored) WHERE k = 1")
def _(spark, d):
    unit = S.infer_unit_size(F.col("ranges"), F.lit(START).cast("bigint"), F.col("size"))
    return parsed(spark, d).select("gt_pos", unit.alias("unit_size"))


@check("infer_unit_size_gcd", FIT.replace("{GCD}", LIST_GCD) + """ SELECT gt_pos, CAST(u AS BIGINT) AS unit_size FROM (SELECT *, row_number() OVER (PARTITION BY gt_pos ORDER BY differs, mis,
  CASE WHEN g * 512 = u THEN greatest(0, over - 1) ELSE over END, rank) AS k FROM scored) WHERE k = 1""")
def _(spark, d):
    unit = S.infer_unit_size(F.col("ranges"), F.lit(START).cast("bigint"), F.col("size"), gcd_hint=True)
    return parsed(spark, d).select("gt_pos", unit.alias("unit_size"))


@check("validate_geometry", PLAIN_FIT + """, best AS (SELECT gt_pos, u FROM (SELECT *, row_number() OVER (PARTITION BY gt_pos ORDER BY differs, mis, over, rank) AS k FROM scored) WHERE k = 1)
SELECT s.gt_pos, CAST(CASE WHEN differs = 0 AND mis = 0 AND over <= 64 THEN s.u ELSE best.u END AS BIGINT) AS unit_size, CASE WHEN differs = 0 AND mis = 0 AND over <= 64 THEN 'fsstat' ELSE 'inferred' END AS source
FROM scored s JOIN best USING (gt_pos) WHERE s.u = CASE WHEN s.gt_pos % 2 = 0 THEN 4096 ELSE 1024 END""")
def _(spark, d):
    given = F.when(F.col("gt_pos") % 2 == 0, 4096).otherwise(1024).cast("bigint")
    checked = S.validate_geometry(F.col("ranges"), F.lit(START).cast("bigint"), F.col("size"), given)
    return B.compute_once(parsed(spark, d), checked).select("gt_pos", "unit_size", "source")


@check("print_mode", SPANS + """ SELECT gt_pos, CASE WHEN count(DISTINCT u) = any_value((size + 4095) // 4096) THEN 'fs' ELSE 'sector' END AS mode FROM
  (SELECT gt_pos, unnest(generate_series((s - 63) // 8, (e - 63) // 8)) AS u FROM spans) JOIN r USING (gt_pos) GROUP BY gt_pos""")
def _(spark, d):
    units = B.sectors_to_units(F.col("ranges"), F.lit(START).cast("bigint"), F.lit(8).cast("bigint"))
    return parsed(spark, d).select("gt_pos", S.print_mode(units, F.col("size"), F.lit(4096).cast("bigint")).alias("mode"))


# order numbers as names: F12-1 is part of F112-1's tail "12-1.txt", so partial matches occur
ASKED = """, asked AS (SELECT base_test_case, gt_pos AS update_pos, concat('dir/', substring(file_name, 3)) AS file_name, concat(dfr_blocks, CASE WHEN gt_pos % 3 = 0 THEN ', 1' ELSE '' END) AS new_blocks FROM dfr_gt),
tokens AS (SELECT *, lower(split_part(file_name, '/', -1)) AS token FROM asked),
grams AS (SELECT DISTINCT base_test_case, lower(file_name) AS name, unnest(list_transform(range(1, length(file_name) + 1), lambda i: substring(lower(file_name), CAST(i AS BIGINT)))) AS suffix FROM dfr_gt),
hits AS (SELECT t.update_pos, t.token, t.base_test_case, t.new_blocks, g.gt_pos, g.dfr_blocks, g.size, lower(g.file_name) AS name FROM tokens t JOIN grams s ON s.base_test_case = t.base_test_case AND s.suffix = t.token JOIN dfr_gt g ON g.base_test_case = s.base_test_case AND lower(g.file_name) = s.name),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY update_pos ORDER BY name = token DESC, length(name) DESC, gt_pos) AS r FROM hits) WHERE r = 1)"""


def asked(spark, d):
    # written, as the operators read it several times, and each time its rows are numbered by a sort of the whole table
    gt = stage(view(spark, d, "dfr_gt"))
    return gt, gt.select(
        "base_test_case", F.col("gt_pos").alias("update_pos"), F.concat(F.lit("dir/"), F.substr("file_name", F.lit(3))).alias("file_name"),
        F.concat("dfr_blocks", F.when(F.col("gt_pos") % 3 == 0, ", 1").otherwise("")).alias("new_blocks"),
    )


@check("merge_gt_blocks", with_views("dfr_gt") + ASKED + """, changed AS (SELECT gt_pos, arg_max(new_blocks, update_pos) AS nb FROM top GROUP BY gt_pos)
SELECT g.gt_pos, coalesce(nb, g.dfr_blocks) AS dfr_blocks FROM dfr_gt g LEFT JOIN changed USING (gt_pos)""")
def _(spark, d):
    merged, _outcome = C.merge_gt_blocks(*asked(spark, d), ["base_test_case"])
    return merged.select("gt_pos", "dfr_blocks")


@check("merge_gt_outcome", with_views("dfr_gt") + ASKED + """ SELECT t.update_pos, t.base_test_case, count(*) FILTER (gt_pos IS NOT NULL AND dfr_blocks <> t.new_blocks) AS updated,
 count(*) FILTER (gt_pos IS NOT NULL AND dfr_blocks = t.new_blocks) AS unchanged, count(*) FILTER (gt_pos IS NULL) AS not_found FROM tokens t LEFT JOIN hits h USING (update_pos) GROUP BY ALL""")
def _(spark, d):
    _merged, outcome = C.merge_gt_blocks(*asked(spark, d), ["base_test_case"], all_matches=True)
    return outcome


@check("top1_name_match", with_views("dfr_gt") + ASKED + " SELECT update_pos, CASE WHEN dfr_blocks = new_blocks THEN 1 ELSE 0 END AS unchanged, CASE WHEN dfr_blocks = new_blocks THEN 0 ELSE 1 END AS updated FROM top")
def _(spark, d):
    _merged, outcome = C.merge_gt_blocks(*asked(spark, d), ["base_test_case"])
    return outcome.select("update_pos", "unchanged", "updated")


@check("file_size_lookup", with_views("dfr_gt") + ASKED + """ SELECT t.update_pos, coalesce(size, 0) AS size FROM tokens t LEFT JOIN
  (SELECT update_pos, size FROM (SELECT *, row_number() OVER (PARTITION BY update_pos ORDER BY length(name) DESC, gt_pos) AS k FROM hits) WHERE k = 1) USING (update_pos)""")
def _(spark, d):
    gt, updates = asked(spark, d)
    names = updates.select("base_test_case", "update_pos", F.substring_index("file_name", "/", -1).alias("name"))
    return C.file_size_lookup(gt, names, ["base_test_case"]).select("update_pos", "size")


@check("gt_contains", with_views("dfr_gt") + """ SELECT a.base_test_case, count(*) AS n, min(g.gt_pos) AS first_pos FROM (SELECT DISTINCT upper(substring(base_test_case, 3)) AS base_test_case FROM dfr_gt) a
  JOIN dfr_gt g ON contains(lower(g.base_test_case), lower(a.base_test_case)) GROUP BY ALL""")
def _(spark, d):
    gt = view(spark, d, "dfr_gt")
    runs = gt.select(F.upper(F.substr("base_test_case", F.lit(3))).alias("base_test_case")).distinct()
    return C.gt_contains(gt, runs, ["gt_pos"]).groupBy("base_test_case").agg(F.count("*").alias("n"), F.min("gt_pos").alias("first_pos"))


@check("derive_case", """SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN concat('image-', source) ELSE source END, '^image-', 'carv-') AS base_test_case FROM documents""")
def _(spark, d):
    image = F.concat(F.when(F.col("doc_id") % 2 == 0, "image-").otherwise(""), "source", F.when(F.col("doc_id") % 3 == 0, ".DD").otherwise(".dd"))
    return view(spark, d, "documents").select("doc_id", derive_case(image).alias("base_test_case"))


@check("strip_dup_suffix", """SELECT p_partkey, concat(replace(p_name, ' ', '_'), '.txt') AS name FROM part""")
def _(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"), F.col("p_size").cast("string"))
    return view(spark, d, "part").select("p_partkey", strip_dup_suffix(name).alias("name"))


@check("safe_file_name", r"""SELECT page_id, CASE WHEN s = '' THEN 'result' ELSE s END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[/\\]', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s FROM pages)""")
def _(spark, d):
    return view(spark, d, "pages").select("page_id", safe_file_name(F.col("url")).alias("name"))


@check("parse_bool", """SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'F' THEN false ELSE true END AS flag, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, d):
    word = F.when(F.col("o_orderstatus") == "O", " Yes ").when(F.col("o_orderstatus") == "F", "no")
    return view(spark, d, "orders").groupBy("o_orderstatus", parse_bool(word, default=True).alias("flag")).agg(F.count("*").alias("n"))


@check("resolve_suite", """SELECT c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'deleted_file_recovery' WHEN 'BUILDING' THEN 'windows_registry' WHEN 'MACHINERY' THEN 'sqlite_recovery' END AS suite, count(*) AS n FROM customer GROUP BY ALL""")
def _(spark, d):
    seg = F.col("c_mktsegment")
    word = F.when(seg == "AUTOMOBILE", " DFR").when(seg == "BUILDING", "wr ").when(seg == "MACHINERY", "SQLite-Recovery").otherwise(seg)
    return view(spark, d, "customer").groupBy("c_mktsegment", resolve_suite(word).alias("suite")).agg(F.count("*").alias("n"))
