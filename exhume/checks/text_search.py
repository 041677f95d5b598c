"""Checks for string search, registry, SQLite and suite scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from exhume.checks.fixtures import check, view, with_views
from exhume.functions.text import case_key, line_id, norm_type
from exhume.functions.values import value_matches
from exhume.operators.ground_truth import gt_deleted, gt_exact, gt_prefix
from exhume.plans import registry, sqlite, string_search, suite
from exhume.session import stage

PRF = """
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall"""
F1 = "CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1"

SS_IDS = r"""
ids AS (SELECT base_test_case, os, tool_used, nullif(regexp_extract(line, '\b([0-9]{4})\b', 1), '') AS file_line FROM ss_sub),
gtmap AS (SELECT base_test_case, os, file_line, CASE WHEN t IN ('unalloc','unalocated','un-allocated') THEN 'unallocated' ELSE t END AS type
  FROM (SELECT base_test_case, os, file_line, lower(trim(type)) AS t,
    row_number() OVER (PARTITION BY base_test_case, os, file_line ORDER BY gt_pos DESC) AS r FROM ss_gt) WHERE r = 1),
pairs AS (SELECT DISTINCT * FROM ids WHERE file_line IS NOT NULL),
runs AS (SELECT DISTINCT base_test_case, os, tool_used FROM ids),
both_sides AS (SELECT coalesce(s.base_test_case, g.base_test_case) AS base_test_case, coalesce(s.os, g.os) AS os,
    coalesce(s.tool_used, g.tool_used) AS tool_used, coalesce(s.file_line, g.file_line) AS file_line,
    s.file_line AS sl, g.file_line AS gl, g.type AS type
  FROM pairs s FULL JOIN (SELECT r.tool_used, gtmap.* FROM gtmap JOIN runs r USING (base_test_case, os)) g
    ON s.base_test_case = g.base_test_case AND s.os = g.os AND s.tool_used = g.tool_used AND s.file_line = g.file_line),
counts AS (SELECT base_test_case, os, tool_used, count(gl) AS total_gt_lines, count(sl) AS total_submitted_lines,
    count(*) FILTER (sl IS NOT NULL AND gl IS NOT NULL) AS tp, count(*) FILTER (gl IS NULL) AS fp, count(*) FILTER (sl IS NULL) AS fn,
    count(*) FILTER (sl IS NOT NULL AND type = 'active') AS hits_active,
    count(*) FILTER (sl IS NOT NULL AND type = 'deleted') AS hits_deleted,
    count(*) FILTER (sl IS NOT NULL AND type = 'unallocated') AS hits_unallocated
  FROM both_sides GROUP BY ALL),
ss_score AS (SELECT *, """ + F1 + " FROM (SELECT *, " + PRF + " FROM counts))"
SS = with_views("ss_gt", "ss_sub") + "," + SS_IDS


def ss(spark, d):
    return view(spark, d, "ss_sub"), view(spark, d, "ss_gt")


@check("string_search_score", SS + " SELECT * FROM ss_score")
def _(spark, d):
    return string_search.string_search_score(*ss(spark, d))


@check("string_search_keys", SS + """ SELECT base_test_case, os, tool_used, file_line,
  CASE WHEN gl IS NULL THEN 'FP' WHEN sl IS NULL THEN 'FN' ELSE 'TP' END AS status FROM both_sides""")
def _(spark, d):
    return string_search.string_search_keys(*ss(spark, d))


@check("line_id", SS + " SELECT file_line, count(*) AS n FROM ids GROUP BY file_line")
def _(spark, d):
    sub, _gt = ss(spark, d)
    return sub.groupBy(line_id(F.col("line")).alias("file_line")).agg(F.count("*").alias("n"))


@check("norm_type", with_views("ss_gt") + """ SELECT CASE WHEN t IN ('unalloc','unalocated','un-allocated') THEN 'unallocated' ELSE t END AS type, count(*) AS n
  FROM (SELECT lower(trim(type)) AS t FROM ss_gt) GROUP BY 1""")
def _(spark, d):
    _sub, gt = ss(spark, d)
    return gt.groupBy(norm_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


@check("gt_exact", with_views("ss_gt", "ss_sub") + """ SELECT r.base_test_case, r.os, r.tool_used, count(*) AS gt_rows, CAST(sum(gt_pos) AS BIGINT) AS pos_sum
  FROM (SELECT DISTINCT upper(base_test_case) AS base_test_case, concat(os, ' ') AS os, tool_used FROM ss_sub) r
  JOIN ss_gt g ON lower(r.base_test_case) = lower(g.base_test_case) AND rtrim(r.os) = g.os GROUP BY ALL""")
def _(spark, d):
    sub, gt = ss(spark, d)
    runs = sub.select(
        F.upper("base_test_case").alias("base_test_case"), F.concat("os", F.lit(" ")).alias("os"), "tool_used"
    ).distinct()
    return gt_exact(gt, runs, ["gt_pos"]).groupBy("base_test_case", "os", "tool_used").agg(
        F.count("*").alias("gt_rows"), F.sum("gt_pos").alias("pos_sum")
    )


@check("gt_deleted", with_views("ss_gt", "ss_sub") + """ SELECT r.base_test_case, r.tool_used, g.os, g.file_line
  FROM (SELECT DISTINCT base_test_case, tool_used FROM ss_sub) r JOIN ss_gt g USING (base_test_case) WHERE lower(type) = 'deleted'""")
def _(spark, d):
    sub, gt = ss(spark, d)
    runs = sub.select("base_test_case", "tool_used").distinct()
    return gt_deleted(gt, runs, ["os", "file_line"])


@check("gt_prefix", with_views("dfr_gt") + """ SELECT r.asked, r.file_name, arg_min(g.base_test_case, g.gt_pos) AS gt_case, min(g.gt_pos) AS gt_pos, count(*) AS gt_rows
  FROM (SELECT DISTINCT substring(base_test_case, 1, 5) AS asked, file_name FROM dfr_gt) r
  JOIN dfr_gt g ON g.file_name = r.file_name AND starts_with(g.base_test_case, r.asked) GROUP BY ALL""")
def _(spark, d):
    gt = view(spark, d, "dfr_gt")
    runs = gt.select(F.left("base_test_case", F.lit(5)).alias("base_test_case"), "file_name").distinct()
    hits = gt_prefix(gt.withColumn("gt_case", F.col("base_test_case")), runs, ["gt_pos", "gt_case"])
    return hits.groupBy(F.col("base_test_case").alias("asked"), "file_name").agg(
        F.min_by("gt_case", "gt_pos").alias("gt_case"), F.min("gt_pos").alias("gt_pos"), F.count("*").alias("gt_rows")
    )


REG = with_views("reg_gt", "reg_sub") + """,
s AS (SELECT base_test_case, tool_used, concat(trim(path), '|', trim(value)) AS k FROM reg_sub WHERE NOT regexp_matches(path, 'FILE_INFO|PROCESSING_SUMMARY', 'i')),
g AS (SELECT base_test_case, concat(trim(path), '|', trim(value)) AS k FROM reg_gt WHERE NOT regexp_matches(path, 'FILE_INFO|PROCESSING_SUMMARY', 'i')),
sn AS (SELECT base_test_case, tool_used, count(*) AS total_submitted, count(DISTINCT k) AS ns FROM s GROUP BY ALL),
gn AS (SELECT base_test_case, count(*) AS total_ground_truth, count(DISTINCT k) AS ng FROM g GROUP BY ALL),
m AS (SELECT s.base_test_case, s.tool_used, count(DISTINCT s.k) AS tp FROM s JOIN g USING (base_test_case, k) GROUP BY ALL),
counts AS (SELECT base_test_case, tool_used, tp, ns - tp AS fp, ng - tp AS fn, total_submitted, total_ground_truth FROM sn JOIN gn USING (base_test_case) JOIN m USING (base_test_case, tool_used))
SELECT *, tp / (tp + fp + fn) AS similarity_score, """ + F1 + " FROM (SELECT *, " + PRF + " FROM counts)"


@check("registry_score", REG)
def _(spark, d):
    return registry.registry_score(view(spark, d, "reg_sub"), view(spark, d, "reg_gt"))


@check("drop_meta_rows", with_views("reg_gt") + """ SELECT base_test_case, count(*) AS n FROM reg_gt
  WHERE NOT contains(lower(path), 'file_info') AND NOT contains(lower(path), 'processing_summary') GROUP BY ALL""")
def _(spark, d):
    return registry.drop_meta_rows(view(spark, d, "reg_gt")).groupBy("base_test_case").agg(F.count("*").alias("n"))


MATCH = """CASE WHEN e IS NULL OR trim(e) = '' THEN true
    WHEN try_cast(p AS DOUBLE) IS NOT NULL AND try_cast(e AS DOUBLE) IS NOT NULL THEN try_cast(p AS DOUBLE) = try_cast(e AS DOUBLE)
    ELSE contains(lower(coalesce(p, 'none')), lower(e)) END"""
ATTR = with_views("attr_gt", "attr_sub") + f""",
cmp AS (SELECT p_partkey, k, p AS predicted, e AS expected, {MATCH} AS match FROM
  (SELECT s.p_partkey, s.k, s.v AS p, g.v AS e FROM attr_sub s LEFT JOIN attr_gt g USING (p_partkey, k)))"""
KEYED_COUNTS = ", count(*) FILTER (match) AS tp, count(*) FILTER (NOT match) AS fp, count(*) FILTER (NOT match) AS fn"


def attributes(spark, d):
    sub = view(spark, d, "attr_sub").select("p_partkey", "k", F.col("v").alias("predicted"))
    gt = view(spark, d, "attr_gt").select("p_partkey", "k", F.col("v").alias("expected"))
    return sub, gt


@check("value_matches", ATTR + " SELECT k, match, count(*) AS n FROM cmp GROUP BY ALL")
def _(spark, d):
    sub, gt = attributes(spark, d)
    m = value_matches(F.col("predicted"), F.col("expected")).alias("match")
    return sub.join(gt, ["p_partkey", "k"], "left").groupBy("k", m).agg(F.count("*").alias("n"))


@check("attribute_compare", ATTR + " SELECT * FROM cmp")
def _(spark, d):
    return sqlite.attribute_compare(*attributes(spark, d), ["p_partkey"])


POS = with_views("pos_gt", "pos_sub") + f""",
cmp AS (SELECT l_orderkey, pos, e IS NULL OR trim(e) = '' AS blank, {MATCH} AS match FROM
  (SELECT s.l_orderkey, s.pos, s.predicted AS p, g.file_line AS e FROM pos_sub s
   LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY gt_pos) - 1 AS pos FROM pos_gt) g
   ON s.l_orderkey = g.l_orderkey AND s.pos = g.pos)),
counts AS (SELECT l_orderkey, tp, fp, n - tp AS fn FROM (SELECT l_orderkey, count(*) FILTER (match) + count(*) FILTER (blank) AS tp,
  count(*) FILTER (NOT match) AS fp, count(*) AS n FROM cmp GROUP BY ALL))"""


@check("positional_score", POS + " SELECT *, " + F1 + " FROM (SELECT *, " + PRF + " FROM counts)")
def _(spark, d):
    compared = sqlite.positional_compare(view(spark, d, "pos_sub"), view(spark, d, "pos_gt"), ["l_orderkey"])
    return sqlite.positional_score(compared, ["l_orderkey"])


SQLITE = with_views("attr_gt", "attr_sub", "pos_gt", "pos_sub") + f""",
kcmp AS (SELECT p_partkey, {MATCH} AS match FROM
  (SELECT s.p_partkey, s.k, s.v AS p, g.v AS e FROM attr_sub s LEFT JOIN attr_gt g USING (p_partkey, k))),
pcmp AS (SELECT l_orderkey, e IS NULL OR trim(e) = '' AS blank, {MATCH} AS match FROM
  (SELECT s.l_orderkey, s.pos, s.predicted AS p, g.file_line AS e FROM pos_sub s
   LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY gt_pos) - 1 AS pos FROM pos_gt) g
   ON s.l_orderkey = g.l_orderkey AND s.pos = g.pos)),
counts AS (
  SELECT concat('K-', CAST(p_partkey AS VARCHAR)) AS run_id, CASE p_partkey % 3 WHEN 0 THEN 'SFT01' WHEN 1 THEN 'SFT02' ELSE 'SFT05' END AS task_id{KEYED_COUNTS}
  FROM kcmp WHERE p_partkey % 3 <> 2 GROUP BY ALL
  UNION ALL SELECT concat('K-', CAST(p_partkey AS VARCHAR)), 'SFT05', 3, 0, 0 FROM kcmp WHERE p_partkey % 3 = 2 GROUP BY ALL
  UNION ALL SELECT concat('P-', CAST(l_orderkey AS VARCHAR)), 'SFT03', tp, fp, n - tp FROM (SELECT l_orderkey,
    count(*) FILTER (match) + count(*) FILTER (blank) AS tp, count(*) FILTER (NOT match) AS fp, count(*) AS n FROM pcmp GROUP BY ALL))
SELECT *, {F1} FROM (SELECT *, {PRF} FROM counts)"""


def sqlite_frames(spark, d):
    """Every part is a keyed run, every order a positional one; the SFT05 ground truth has no such keys."""
    entries = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    key = F.concat(F.lit("K-"), F.col("p_partkey").cast("string"))
    order = F.concat(F.lit("P-"), F.col("l_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    task = F.when(F.col("p_partkey") % 3 == 0, "SFT01").when(F.col("p_partkey") % 3 == 1, "SFT02").otherwise("SFT05")
    keyed = view(spark, d, "attr_sub").groupBy("p_partkey").agg(entries.alias("attributes")).select(
        key.alias("run_id"), task.alias("task_id"), key.alias("base_test_case"), F.lit("a.sqlite").alias("file_name"),
        F.when(task == "SFT02", "t").alias("sqlite_table_name"), "attributes",
        F.lit(None).cast("array<string>").alias("file_lines"),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "predicted"))), lambda p: p["predicted"])
    # three reads of one numbering; written, so that the rows are sorted once
    numbered = {"dfr_files": stage(view(spark, d, "dfr_files").select("l_orderkey", "rn", "l_quantity", "l_returnflag", "l_linenumber"))}
    listed = view(spark, d, "pos_sub", numbered).groupBy("l_orderkey").agg(lines.alias("file_lines")).select(
        order.alias("run_id"), F.lit("SFT03").alias("task_id"), order.alias("base_test_case"),
        F.lit("b.sqlite").alias("file_name"), none.alias("sqlite_table_name"),
        F.lit(None).cast("map<string,string>").alias("attributes"), "file_lines",
    )
    gt_keyed = view(spark, d, "attr_gt").groupBy("p_partkey").agg(entries.alias("attributes")).select(
        F.col("p_partkey").alias("gt_pos"), key.alias("base_test_case"), F.lit("A.sqlite").alias("file_name"),
        F.lit("t").alias("sqlite_table_name"), none.alias("sqlite_cmd"), none.alias("file_line"), "attributes",
    )
    gt_listed = view(spark, d, "pos_gt", numbered).select(
        "gt_pos", F.concat(order, F.lit("-win")).alias("base_test_case"), F.lit("b.sqlite").alias("file_name"),
        none.alias("sqlite_table_name"), none.alias("sqlite_cmd"), "file_line",
        F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    # '-win' is only reached by the prefix lookup; a closing '-' keeps P-1 from being a prefix of P-10
    listed = listed.withColumn("base_test_case", F.concat("base_test_case", F.lit("-")))
    return keyed.unionByName(listed), gt_keyed.unionByName(gt_listed)


@check("sqlite_score", SQLITE)
def _(spark, d):
    return sqlite.sqlite_score(*sqlite_frames(spark, d))


SUITE_ROWS = SS + """, results AS (SELECT 'string_search' AS test_suite, base_test_case, tool_used, f1, concat(base_test_case, os, tool_used) AS row_pos FROM ss_score)"""


def suite_rows(spark, d):
    score = string_search.string_search_score(*ss(spark, d))
    return score.select(
        F.lit("string_search").alias("test_suite"), "base_test_case", "tool_used", "f1",
        F.concat("base_test_case", "os", "tool_used").alias("row_pos"),
    )


@check("suite_report", SUITE_ROWS + """
SELECT test_suite, base_test_case, tool_used, f1, false AS is_summary, CAST(NULL AS DOUBLE) AS suite_score FROM results
UNION ALL SELECT test_suite, 'SUITE_SCORE', arg_min(tool_used, row_pos), NULL, true, round(avg(f1), 6) FROM results GROUP BY test_suite""")
def _(spark, d):
    return suite.suite_report(suite_rows(spark, d)).withColumn("suite_score", F.round("suite_score", 6))


@check("suite_rollup", SUITE_ROWS + """
SELECT test_suite, tool_used, round(avg(f1), 9) AS suite_score, count(f1) AS scored,
  CAST(grouping(test_suite) * 2 + grouping(tool_used) AS BIGINT) AS level FROM results GROUP BY ROLLUP (test_suite, tool_used)""")
def _(spark, d):
    return suite.suite_rollup(suite_rows(spark, d)).withColumn("suite_score", F.round("suite_score", 9))


@check("gt_case_key", with_views("ss_gt") + " SELECT DISTINCT lower(rtrim(concat(base_test_case, '  '))) AS case_key FROM ss_gt")
def _(spark, d):
    gt = view(spark, d, "ss_gt")
    return gt.select(case_key(F.concat("base_test_case", F.lit("  "))).alias("case_key")).distinct()
