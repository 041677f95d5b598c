"""Checks for deleted-file recovery: block lists, names, matching, assignment, flags, scores, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from exhume.checks.fixtures import check, view, with_views
from exhume.checks.text_search import F1, PRF
from exhume.functions import blocks as B
from exhume.functions.names import name_key
from exhume.functions.text import null_token, to_int
from exhume.operators import file_match as M
from exhume.operators.assign import assign_unique
from exhume.operators.ordered import first_rows, rank_in_group
from exhume.functions.metrics import with_prf
from exhume.operators.validate import dfr_reasons, gt_presence, in_enum, single_gt_file
from exhume.plans import dfr
from exhume.session import stage

RUN = ["base_test_case", "tool_used"]


def _tokens(col: str) -> str:
    bare = f"replace(replace({col}, '[', ''), ']', '')"
    return f"list_filter(list_transform(string_split({bare}, ','), lambda x: trim(x)), lambda x: x <> '')"


def _numbers(col: str) -> str:
    a, b = "CAST(split_part(t, '-', 1) AS BIGINT)", "CAST(split_part(t, '-', -1) AS BIGINT)"
    return f"flatten(list_transform({_tokens(col)}, lambda t: generate_series(least({a}, {b}), greatest({a}, {b}))))"


def _set(col: str) -> str:
    return f"list_sort(list_distinct(list_filter({_numbers(col)}, lambda x: x > 0)))"


KEY = "CASE WHEN fs = 'FAT' THEN lower(substring(f, 2)) ELSE f END"
BASE = with_views("dfr_gt", "dfr_sub") + f""",
gt AS (SELECT *, {_set('dfr_blocks')} AS bset FROM dfr_gt),
sub AS (SELECT *, {_set('blocks')} AS bset, split_part(file_name, '/', -1) AS f, try_cast(file_size AS BIGINT) AS sz FROM dfr_sub),
kinds AS (SELECT *, CASE test_set WHEN 'FILE_SIZE_TESTS' THEN 'size' WHEN 'SPECAIL_NTFS_TEST' THEN 'name_size'
  WHEN 'SPECAIL_OBJECTS_TESTS' THEN 'name_size' WHEN 'MAC_TIME_TESTS' THEN 'times' WHEN 'NON_LATIN_CHAR_TETS' THEN 'name' END AS kind,
  CASE WHEN file_system = 'FAT' THEN lower(substring(f, 2)) ELSE f END AS nkey FROM sub),
gtk AS (SELECT g.*, r.kind, CASE WHEN r.file_system = 'FAT' THEN lower(substring(g.file_name, 2)) ELSE g.file_name END AS nkey
  FROM gt g JOIN (SELECT DISTINCT base_test_case, kind, file_system FROM kinds) r USING (base_test_case)),
name_first AS (SELECT base_test_case, nkey, arg_min(file_name, gt_pos) AS n_file, arg_min(size, gt_pos) AS n_size, arg_min(len(bset), gt_pos) AS n_set FROM gtk GROUP BY ALL),
set_first AS (SELECT base_test_case, bset, arg_min(file_name, gt_pos) AS b_file, arg_min(size, gt_pos) AS b_size, len(bset) AS b_set FROM gt WHERE len(bset) > 0 GROUP BY ALL),
matched AS (SELECT k.*, n_file, n_size, n_set, b_file, b_size, b_set FROM kinds k
  LEFT JOIN name_first n ON n.base_test_case = k.base_test_case AND n.nkey = k.nkey
  LEFT JOIN set_first b ON b.base_test_case = k.base_test_case AND b.bset = k.bset),
firsts AS (SELECT m.sub_pos, m.tool_used, count(*) AS f_rows, max(g.size) AS f_size,
    bool_or(g.file_name IS DISTINCT FROM m.n_file AND g.file_name IS DISTINCT FROM m.b_file AND len(g.bset) < len(m.bset)) AS f_over
  FROM matched m JOIN gt g ON g.base_test_case = m.base_test_case AND g.bset[1] = m.bset[1] GROUP BY ALL),
akeys AS (SELECT base_test_case, tool_used, sub_pos, CASE kind WHEN 'size' THEN file_size WHEN 'name_size' THEN concat(file_size, '|', nkey)
    WHEN 'times' THEN concat(modified_timestamp, '|', accessed_timestamp, '|', changed_timestamp) ELSE nkey END AS k FROM kinds WHERE kind IS NOT NULL),
gkeys AS (SELECT base_test_case, file_name, gt_pos, CASE kind WHEN 'size' THEN CAST(size AS VARCHAR) WHEN 'name_size' THEN concat(CAST(size AS VARCHAR), '|', nkey)
    WHEN 'times' THEN concat(CAST(modified_timestamp AS VARCHAR), '|', CAST(accessed_timestamp AS VARCHAR), '|', CAST(changed_timestamp AS VARCHAR)) ELSE nkey END AS k FROM gtk WHERE kind IS NOT NULL),
assigned AS (SELECT s.base_test_case, s.tool_used, s.sub_pos, s.k, g.file_name AS a_file FROM
  (SELECT *, row_number() OVER (PARTITION BY base_test_case, tool_used, k ORDER BY sub_pos) AS r FROM akeys) s LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY base_test_case, k ORDER BY gt_pos) AS r FROM gkeys) g USING (base_test_case, k, r)),
flags AS (SELECT m.*, len(m.bset) > 0 AS ss, b_file IS NOT NULL AS "full", f_rows IS NOT NULL AS first, n_file IS NOT NULL AS match,
    coalesce(n_set > 0 AND n_set < len(m.bset), false) OR coalesce(b_file <> n_file AND b_set < len(m.bset), false) OR coalesce(f_over, false) AS over,
    f_rows IS NOT NULL AND b_file IS NULL AS multi,
    CASE WHEN test_set = 'FILE_SIZE_TESTS' THEN EXISTS (SELECT 1 FROM gt g WHERE g.base_test_case = m.base_test_case AND g.size = m.sz)
      WHEN coalesce(n_size = sz, false) THEN true WHEN b_file IS NOT NULL THEN b_size = sz
      ELSE coalesce(f_rows = 1 AND f_size = sz, false) END AS size_match,
    CASE WHEN kind IS NULL THEN b_file ELSE a_file END AS mapped_f1
  FROM matched m LEFT JOIN firsts f USING (sub_pos, tool_used) LEFT JOIN assigned a USING (sub_pos, tool_used))"""


def frames(spark, d):
    """Submissions and ground truth. The numbered rows behind both are written once, as numbering them sorts the whole table."""
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus", "rn", "mtime", "pos")
    made = {"dfr_files": stage(view(spark, d, "dfr_files").select(*columns))}
    return view(spark, d, "dfr_sub", made), view(spark, d, "dfr_gt", made)


def prepared(spark, d):
    sub, gt = frames(spark, d)
    return M.prepare_submission(sub, RUN), M.prepare_ground_truth(gt)


@check("parse_blocks", BASE + f"""
SELECT blocks, array_to_string({_tokens('blocks')}, ' ') AS tokens, CAST(len({_numbers('blocks')}) AS BIGINT) AS n_tokens,
  CAST(len(bset) AS BIGINT) AS n_blocks, list_min(bset) AS first_block, CAST(list_sum(bset) AS BIGINT) AS block_sum FROM sub""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    parsed = sub.withColumn("_t", B.parse_blocks(F.col("blocks"))).withColumn("_r", B.token_ranges(F.col("_t")))
    total = F.aggregate(
        "_s", F.lit(0).cast("bigint"), lambda a, r: a + F.call_function("div", (r["s"] + r["e"]) * (r["e"] - r["s"] + 1), F.lit(2))
    )
    return parsed.withColumn("_s", B.block_set(F.col("_r"))).select(
        "blocks", F.array_join("_t", " ").alias("tokens"), B.token_count(F.col("_r")).alias("n_tokens"),
        B.range_count(F.col("_s")).alias("n_blocks"), B.first_block(F.col("_s")).alias("first_block"),
        F.when(F.size("_s") > 0, total).alias("block_sum"),
    )


@check("block_set_text", BASE + """
SELECT sub_pos, array_to_string(bset, ',') AS block_list FROM sub""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    merged = B.block_set(B.token_ranges(B.parse_blocks(F.col("blocks"))))
    numbers = F.flatten(F.transform(merged, lambda r: F.sequence(r["s"], r["e"])))
    return sub.select("sub_pos", F.array_join(numbers.cast("array<string>"), ",").alias("block_list"))


@check("compress_ranges", BASE + """,
cells AS (SELECT sub_pos, unnest(bset) AS n FROM sub),
isl AS (SELECT sub_pos, min(n) AS lo, max(n) AS hi FROM (SELECT *, n - row_number() OVER (PARTITION BY sub_pos ORDER BY n) AS g FROM cells) GROUP BY sub_pos, g)
SELECT sub_pos, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE concat(CAST(lo AS VARCHAR), '-', CAST(hi AS VARCHAR)) END, ',' ORDER BY lo) AS ranges FROM isl GROUP BY sub_pos""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    return M.with_blocks(sub).select("sub_pos", F.col("block_key").alias("ranges")).filter("ranges is not null")


@check("name_key", BASE + """
SELECT file_system, CASE WHEN file_system = 'FAT' THEN concat('F:', nkey) ELSE concat('N:', nkey) END AS name_key, count(*) AS n FROM kinds GROUP BY ALL""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    return sub.groupBy("file_system", name_key(F.col("file_name"), F.col("file_system")).alias("name_key")).agg(
        F.count("*").alias("n")
    )


@check("name_key_unicode", r"""
SELECT doc_id, CASE WHEN ar THEN concat('A:', regexp_replace(v, '[.]?[tT][xX][tT][0-9]+$', '')) ELSE concat('N:', v) END AS name_key FROM (
SELECT doc_id, v, regexp_matches(v, '[\x{0600}-\x{06FF}]') AS ar FROM (SELECT doc_id,
  translate(nfc_normalize(trim(split_part(raw, '/', -1), concat(' ', chr(9), chr(10), chr(13)))), concat(chr(1633), chr(183), chr(8206)), '1.') AS v
  FROM (SELECT doc_id, concat(text, chr(769), chr(8206), chr(183), CASE WHEN doc_id % 3 = 0 THEN chr(1605) ELSE 'm' END, '.txt', chr(1633)) AS raw FROM documents)))""")
def _(spark, d):
    """Whole document texts with combining accents, a direction mark, a dot look-alike and Arabic digits."""
    docs = view(spark, d, "documents")
    letter = F.when(F.col("doc_id") % 3 == 0, F.lit("م")).otherwise(F.lit("m"))
    raw = F.concat("text", F.lit("́‎·"), letter, F.lit(".txt١"))
    return docs.select("doc_id", name_key(raw, F.lit("NTFS")).alias("name_key"))


@check("to_int", with_views("dfr_sub") + """ SELECT v, n FROM (SELECT CASE WHEN regexp_matches(trim(raw), '^[+-]?[0-9]+$') THEN try_cast(trim(raw) AS BIGINT) END AS v, count(*) AS n FROM
 (SELECT concat(' ', file_size, CASE sub_pos % 4 WHEN 0 THEN '.5' WHEN 1 THEN 'x' ELSE ' ' END) AS raw FROM dfr_sub) GROUP BY 1)""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    tail = F.when(F.col("sub_pos") % 4 == 0, ".5").when(F.col("sub_pos") % 4 == 1, "x").otherwise(" ")
    return sub.groupBy(to_int(F.concat(F.lit(" "), "file_size", tail)).alias("v")).agg(F.count("*").alias("n"))


@check("null_token", with_views("dfr_sub") + """ SELECT v, count(*) AS n FROM (SELECT nullif(nullif(CASE sub_pos % 3 WHEN 0 THEN 'NULL' ELSE blocks END, ''), 'NULL') AS v FROM dfr_sub) GROUP BY 1""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    return sub.groupBy(
        null_token(F.when(F.col("sub_pos") % 3 == 0, "NULL").otherwise(F.col("blocks"))).alias("v")
    ).agg(F.count("*").alias("n"))


@check("first_name_match", BASE + " SELECT base_test_case, tool_used, sub_pos, n_file, n_size FROM matched")
def _(spark, d):
    sub, gt = prepared(spark, d)
    return sub.join(M.name_index(gt), ["_case", "name_key"], "left").select(*RUN, "sub_pos", "n_file", "n_size")


@check("full_block_match", BASE + " SELECT base_test_case, tool_used, sub_pos, b_file, b_size FROM matched")
def _(spark, d):
    sub, gt = prepared(spark, d)
    return M.with_blocks(sub).join(M.block_set_index(gt), ["_case", "block_key"], "left").select(*RUN, "sub_pos", "b_file", "b_size")


@check("first_block_match", BASE + """
SELECT m.base_test_case, m.tool_used, m.sub_pos, m.bset[1] AS first_block, f_rows FROM matched m LEFT JOIN firsts USING (sub_pos, tool_used)""")
def _(spark, d):
    sub, gt = prepared(spark, d)
    return M.with_blocks(sub).join(M.first_block_index(gt), ["_case", "first_block"], "left").select(
        *RUN, "sub_pos", "first_block", "f_rows"
    )


@check("first_by_position", BASE + " SELECT base_test_case, size, arg_min(file_name, gt_pos) AS file_name, min(gt_pos) AS gt_pos FROM gt GROUP BY ALL")
def _(spark, d):
    _sub, gt = frames(spark, d)
    return first_rows(gt, ["base_test_case", "size"], [F.col("gt_pos")], ["file_name", "gt_pos"])


@check("rank_pair", BASE + " SELECT base_test_case, size, file_name, row_number() OVER (PARTITION BY base_test_case, size ORDER BY gt_pos) AS rn FROM gt")
def _(spark, d):
    """Bucketed on purpose: positions span many buckets of this width."""
    _sub, gt = frames(spark, d)
    return rank_in_group(gt, ["base_test_case", "size"], "gt_pos", "rn", width=4096).select(
        "base_test_case", "size", "file_name", "rn"
    )


@check("assign_unique", BASE + " SELECT base_test_case, tool_used, sub_pos, k, a_file FROM assigned")
def _(spark, d):
    sub, gt = prepared(spark, d)
    named = dfr.assign_names(sub, gt, RUN).filter("kind <> 'none'")
    return named.select(*RUN, "sub_pos", F.regexp_replace("key", "[FN]:", "").alias("k"), "a_file")


# one submission after the other: the first name of its key's list that its scope has not given away
@check("assign_unique_shared_names", """
WITH RECURSIVE p AS (SELECT *, concat(p_brand, p_type, p_name) AS scope FROM part),
lists AS (SELECT scope, key, list(file_name ORDER BY gt_pos) AS names FROM
  (SELECT scope, CAST(p_size AS VARCHAR) AS key, concat(p_name, '-', CAST(p_partkey % 7 AS VARCHAR)) AS file_name, min(p_partkey) AS gt_pos FROM p GROUP BY ALL) GROUP BY ALL),
subs AS (SELECT scope, CAST(p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS key, p_partkey AS sub_pos, row_number() OVER (PARTITION BY scope ORDER BY p_partkey) AS turn FROM p),
greedy(scope, turn, key, sub_pos, mapped, taken) AS (
  SELECT DISTINCT scope, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM p
  UNION ALL SELECT scope, turn, key, sub_pos, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM
    (SELECT s.*, g.taken, list_filter(coalesce(l.names, []), lambda x: NOT list_contains(g.taken, x))[1] AS pick
     FROM greedy g JOIN subs s ON s.scope = g.scope AND s.turn = g.turn + 1 LEFT JOIN lists l ON l.scope = s.scope AND l.key = s.key))
SELECT scope, key, sub_pos, mapped FROM greedy WHERE turn > 0""")
def _(spark, d):
    """Parts whose name occurs under several sizes: the round-based path. Lists run per brand and name are the scope, sizes the keys."""
    part = view(spark, d, "part")
    gt = part.select(
        F.concat("p_brand", "p_type", "p_name").alias("scope"), F.col("p_size").cast("string").alias("key"),
        F.concat("p_name", F.lit("-"), (F.col("p_partkey") % 7).cast("string")).alias("file_name"),
        F.col("p_partkey").alias("gt_pos"),
    )
    sub = part.select(
        F.concat("p_brand", "p_type", "p_name").alias("scope"),
        (F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).cast("string").alias("key"),
        F.col("p_partkey").alias("sub_pos"),
    )
    return assign_unique(sub, gt, ["scope"], ["scope"])


@check("assign_full_block", BASE + """
SELECT base_test_case, tool_used, count(DISTINCT b_file) AS mapped, count(*) FILTER (b_file IS NULL) AS unmapped FROM matched WHERE kind IS NULL GROUP BY ALL""")
def _(spark, d):
    sub, gt = prepared(spark, d)
    return (
        M.with_blocks(sub.filter(F.col("test_set").isin(*dfr.BLOCK_SETS)))
        .join(M.block_set_index(gt), ["_case", "block_key"], "left")
        .groupBy(*RUN)
        .agg(F.count_distinct("b_file").alias("mapped"), F.count_if(F.col("b_file").isNull()).alias("unmapped"))
    )


@check("dfr_details", BASE + """
SELECT base_test_case, tool_used, test_set, sub_pos, file_name AS submitted_file, mapped_f1, CASE WHEN kind = 'name' THEN n_file ELSE mapped_f1 END AS mapped_gt,
  CASE WHEN kind = 'name' THEN n_file ELSE mapped_f1 END IS NOT NULL AS meets_f1, ss, "full", first, match, over, multi, size_match FROM flags""")
def _(spark, d):
    sub, gt = frames(spark, d)
    return dfr.dfr_details(sub, gt, RUN).drop("_case")


@check("dfr_score", BASE + f""",
counted AS (SELECT base_test_case, tool_used, test_set, count(*) AS rec, count(*) FILTER (ss) AS ss, count(*) FILTER ("full") AS "full", count(*) FILTER (first) AS first,
    count(*) FILTER (match) AS match, count(*) FILTER (over) AS over, count(*) FILTER (multi) AS multi, count(*) FILTER (size_match) AS size_match,
    count(DISTINCT mapped_f1) AS mapped, count(*) FILTER (mapped_f1 IS NULL) AS unmapped FROM flags GROUP BY ALL),
cases AS (SELECT base_test_case, count(*) AS gt_count, bool_and(len({_tokens('dfr_blocks')}) > 0) AS all_gt_have_dfr_blocks FROM gt GROUP BY ALL),
counts AS (SELECT c.* EXCLUDE (mapped, unmapped), gt_count, all_gt_have_dfr_blocks,
    CASE WHEN test_set = 'NON_LATIN_CHAR_TETS' THEN match ELSE mapped END AS tp,
    CASE WHEN test_set = 'NON_LATIN_CHAR_TETS' THEN greatest(0, rec - match) ELSE unmapped END AS fp,
    greatest(0, gt_count - CASE WHEN test_set = 'NON_LATIN_CHAR_TETS' THEN match ELSE mapped END) AS fn
  FROM counted c JOIN cases USING (base_test_case))
SELECT *, {F1} FROM (SELECT *, {PRF} FROM counts)""")
def _(spark, d):
    sub, gt = frames(spark, d)
    return dfr.dfr_score(sub, gt, RUN)


@check("required_fields", with_views("dfr_sub") + """,
odd AS (SELECT *, CASE WHEN sub_pos % 4001 = 0 THEN '' ELSE file_name END AS fn, CASE WHEN sub_pos % 3001 = 0 THEN 'NULL' ELSE file_size END AS fs,
  CASE WHEN sub_pos % 2003 = 0 THEN 'soon' ELSE modified_timestamp END AS mt FROM dfr_sub),
per AS (SELECT base_test_case, tool_used, test_set, bool_or(fn = '') AS unnamed, bool_or(fs = 'NULL') AS unsized, bool_or(mt = 'soon') AS untimed, count(*) > count(DISTINCT fn) AS twice FROM odd GROUP BY ALL)
SELECT base_test_case, tool_used, test_set, CASE WHEN test_set = 'OVERWITE_TESTS' THEN 'invalid test_set' WHEN unnamed THEN 'missing file_name'
  WHEN unsized AND test_set IN ('FILE_SIZE_TESTS', 'SPECAIL_NTFS_TEST', 'SPECAIL_OBJECTS_TESTS') THEN 'missing file_size'
  WHEN untimed AND test_set = 'MAC_TIME_TESTS' THEN 'missing timestamp' WHEN twice THEN 'duplicate file_name' END AS reason FROM per""")
def _(spark, d):
    sub, _gt = frames(spark, d)
    broken = (
        sub.withColumn("file_name", F.when(F.col("sub_pos") % 4001 == 0, "").otherwise(F.col("file_name")))
        .withColumn("file_size", F.when(F.col("sub_pos") % 3001 == 0, "NULL").otherwise(F.col("file_size")))
        .withColumn("modified_timestamp", F.when(F.col("sub_pos") % 2003 == 0, "soon").otherwise(F.col("modified_timestamp")))
    )
    runs = sub.select(*RUN, "test_set").distinct().withColumn("check_meta", F.lit("yes"))
    runs = runs.withColumn("kept", F.col("test_set")).withColumn(
        "test_set", F.when(F.col("test_set") == "OVERWITE_TESTS", "OTHER").otherwise(F.col("test_set"))
    )
    return dfr_reasons(runs, broken, RUN).select(*RUN, F.col("kept").alias("test_set"), "reason")


@check("gt_presence", with_views("dfr_sub", "ss_gt") + """
SELECT DISTINCT concat(substring(base_test_case, 1, 3), '-', upper(substring(base_test_case, 5))) AS base_test_case, 'no ground truth' AS reason FROM dfr_sub
WHERE concat(substring(base_test_case, 1, 3), '-', upper(substring(base_test_case, 5))) NOT IN (SELECT concat('DFR-', CAST(n_nationkey AS VARCHAR)) FROM nation)""")
def _(spark, d):
    """Cases of the runs against one ground-truth case per nation."""
    sub, _gt = frames(spark, d)
    gt = view(spark, d, "nation").select(F.concat(F.lit("dfr-"), F.col("n_nationkey").cast("string")).alias("base_test_case"))
    return gt_presence(sub.select("base_test_case").distinct(), gt)


@check("enum_check", with_views("ss_gt") + """ SELECT type, os, lower(trim(type)) IN ('active', 'deleted', 'unallocated') AS type_ok, os IN ('windows', 'linux') AS os_ok, count(*) AS n FROM ss_gt GROUP BY ALL""")
def _(spark, d):
    gt = view(spark, d, "ss_gt")
    return gt.groupBy("type", "os", in_enum("type").alias("type_ok"), in_enum("os").alias("os_ok")).agg(
        F.count("*").alias("n")
    )


@check("prf", f"""WITH counts AS (SELECT l_linenumber % 3 AS tp, l_suppkey % 4 AS fp, l_partkey % 5 AS fn, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, {F1} FROM (SELECT *, {PRF} FROM counts)""")
def _(spark, d):
    grid = view(spark, d, "lineitem").groupBy(
        (F.col("l_linenumber") % 3).alias("tp"), (F.col("l_suppkey") % 4).alias("fp"), (F.col("l_partkey") % 5).alias("fn")
    )
    return with_prf(grid.agg(F.count("*").alias("n")))


@check("single_gt_file", """WITH gt AS (SELECT concat('WR-', CAST(c_nationkey % 7 AS VARCHAR), c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY ALL)
SELECT r.k AS base_test_case, CASE WHEN gt.n IS NULL THEN 'no ground truth' WHEN gt.n <> 1 THEN 'more than one ground truth file' END AS reason
FROM (SELECT DISTINCT concat('WR-', CAST(s_nationkey % 9 AS VARCHAR), 'BUILDING') AS k FROM supplier) r LEFT JOIN gt ON r.k = gt.k""")
def _(spark, d):
    name = lambda n, s: F.concat(F.lit("WR-"), n.cast("string"), s).alias("base_test_case")
    gt = view(spark, d, "customer").select(name(F.col("c_nationkey") % 7, F.col("c_mktsegment")))
    runs = view(spark, d, "supplier").select(name(F.col("s_nationkey") % 9, F.lit("BUILDING"))).distinct()
    return single_gt_file(runs, gt)
