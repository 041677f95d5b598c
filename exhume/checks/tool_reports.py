"""Checks for tool reports, timestamps, keyword search and script records."""

from __future__ import annotations

from pyspark.sql import functions as F

from exhume.checks.fixtures import check, view, with_views
from exhume.functions import blocks as B
from exhume.functions.text import classify_script, extract_code, extract_code_labelled, render_prompt, script_suffix
from exhume.functions.times import to_epoch
from exhume.operators import contains as C
from exhume.operators import records as R
from exhume.operators import reports as P
from exhume.operators.raw_search import keyword_search_raw
from exhume.session import stage


@check("to_epoch", """SELECT o_orderkey, CASE o_orderkey % 9
 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) WHEN 1 THEN CAST(epoch(timezone('America/New_York', o_orderdate + INTERVAL 12 HOUR)) AS BIGINT)
 WHEN 2 THEN CAST(epoch(timezone('Asia/Kolkata', o_orderdate + INTERVAL 12 HOUR)) AS BIGINT) WHEN 3 THEN CAST(epoch(o_orderdate) AS BIGINT) + 43200 WHEN 4 THEN CAST(epoch(o_orderdate) AS BIGINT) + 43200 + 14400
 WHEN 5 THEN CAST(epoch(o_orderdate) AS BIGINT) + 54601 WHEN 6 THEN CAST(epoch(o_orderdate) AS BIGINT) + 54601 - (5 * 3600 + 30 * 60 + 15) WHEN 7 THEN 0 END AS epoch FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate")
    date = F.date_format(day, "yyyy-MM-dd")
    k = F.col("o_orderkey") % 9
    text = (
        F.when(k == 0, F.concat(date, F.lit(" 00:00:00 (GMT)")))
        .when(k == 1, F.concat(date, F.lit(" 12:00:00 (EST)")))
        .when(k == 2, F.concat(F.lit("Mon "), F.date_format(day, "MMM dd"), F.lit(" 12:00:00 IST "), F.date_format(day, "yyyy")))
        .when(k == 3, F.concat(F.lit("Mon "), F.date_format(day, "MMM d"), F.lit(" 12:00:00 "), F.date_format(day, "yyyy")))
        .when(k == 4, F.concat(date, F.lit(" 12:00:00.660434905 -0400")))
        .when(k == 5, F.concat(date, F.lit(" 15:10:01 Z")))
        .when(k == 6, F.concat(date, F.lit(" 15:10:01 +053015")))
        .when(k == 7, F.lit("0000-00-00 00:00:00 (UTC)"))
        .otherwise("soon")
    )
    return view(spark, d, "orders").select("o_orderkey", to_epoch(text).alias("epoch"))


@check("parse_partition_lines", """SELECT s_nationkey AS report, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS slot, s_suppkey * 100 AS "start", s_suppkey * 100 + 99 AS "end",
  CASE s_suppkey % 4 WHEN 0 THEN 'NTFS (0x07)' WHEN 2 THEN 'Linux (0x83)' END AS description FROM supplier WHERE s_suppkey % 4 IN (0, 2)
UNION ALL SELECT s_nationkey, '0', 0, 1000000000000000000, 'raw' FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (s_suppkey % 4 IN (0, 2)) = 0""")
def _(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "NTFS (0x07)").when(k % 4 == 1, "Unallocated").when(k % 4 == 2, "Linux (0x83)").otherwise("DOS Extended (0x05)")
    n = lambda c: F.lpad(c.cast("string"), 10, "0")
    line = F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(":  000:000   "), n(k * 100), F.lit("   "), n(k * 100 + 99), F.lit("   "), n(F.lit(100)), F.lit("   "), kind)
    lines = view(spark, d, "supplier").select(F.col("s_nationkey").alias("report"), k.alias("line_no"), line.alias("line"))
    return P.parse_partition_lines(lines, ["report"])


@check("parse_listing_lines", """SELECT event_type AS report, event_id * 2 AS line_no, 'r/r' AS entry_type, concat(CAST(event_id AS VARCHAR), '-128-3') AS inode, concat('my file ', CAST(user_id AS VARCHAR), '.txt') AS file_name,
  event_id AS file_size, s AS modified_timestamp, s + 60 AS accessed_timestamp, 0 AS changed_timestamp, s AS created_timestamp FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WHERE user_id % 5 <> 0""")
def _(spark, d):
    """One listing per event type; odd line numbers are wrapped tails; user ids divisible by 5 are directories."""
    k = F.col("event_id")
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" (UTC)"))
    ts = F.col("ts").cast("timestamp_ntz")
    kind = F.when(F.col("user_id") % 5 == 0, "d/d").otherwise("r/r")
    head = F.concat(kind, F.lit(" * "), k.cast("string"), F.lit("-128-3:\tmy file "), F.col("user_id").cast("string"), F.lit(".txt\t"), stamp(ts))
    tail = F.concat(F.lit("\t"), stamp(ts + F.expr("INTERVAL 60 SECONDS")), F.lit("\t0000-00-00 00:00:00 (UTC)\t"), stamp(ts), F.lit("\t"), k.cast("string"), F.lit("\t0\t0"))
    wrapped = F.array(F.struct((k * 2).alias("line_no"), head.alias("line")), F.struct((k * 2 + 1).alias("line_no"), F.concat(F.lit("   "), tail).alias("line")))
    whole = F.array(F.struct((k * 2).alias("line_no"), F.concat(head, tail).alias("line")))
    # a wrapped line is joined by a blank, so the wrap sits behind a tab
    rows = view(spark, d, "events").select(F.col("event_type").alias("report"), F.inline(F.when(k % 5 == 0, F.transform(wrapped, lambda x: F.struct(x["line_no"].alias("line_no"), F.when(x["line_no"] % 2 == 0, F.concat(x["line"], F.lit("\t"))).otherwise(x["line"]).alias("line")))).otherwise(whole)))
    return P.parse_listing_lines(rows, ["report"])


SECTION = with_views("dfr_files") + """,
nums AS (SELECT l_orderkey, unnest(generate_series(l_partkey, l_partkey + CAST(l_quantity AS BIGINT) % 8)) AS n FROM dfr_files)
SELECT l_orderkey, count(DISTINCT n) AS n_blocks, min(n) AS first_block, max(n) AS last_block, 1704067207 AS deleted_timestamp FROM nums GROUP BY l_orderkey"""


@check("parse_block_section", SECTION)
def _(spark, d):
    """One report per order: header or data attribute, one block line per item, then unrelated lines."""
    # written, as its lines are read several times, and numbering the rows sorts the whole table
    files = stage(view(spark, d, "dfr_files").select("l_orderkey", "rn", "l_partkey", "l_quantity"))
    numbers = F.concat(F.col("l_partkey").cast("string"), F.lit("-"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint") % 8).cast("string"))
    body = files.select("l_orderkey", (F.col("rn") + 1).cast("bigint").alias("line_no"), numbers.alias("line"))
    head = F.when(F.col("l_orderkey") % 2 == 0, "Direct Blocks:").otherwise("Type: $DATA (128-3)   Name: N/A   Non-Resident   size: 7777")
    frame = files.select("l_orderkey").distinct().select(
        "l_orderkey", F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("Deleted: 2024-01-01 00:00:07 (UTC)").alias("line")),
            F.struct(F.lit(1).cast("bigint").alias("line_no"), head.alias("line")),
            F.struct(F.lit(100).cast("bigint").alias("line_no"), F.lit("").alias("line")),
            F.struct(F.lit(101).cast("bigint").alias("line_no"), F.lit("Links: 99").alias("line")),
            F.struct(F.lit(102).cast("bigint").alias("line_no"), F.lit("123456789 987654321").alias("line")),
        )),
    )
    parsed = P.parse_block_section(body.unionByName(frame), ["l_orderkey"])
    return parsed.select(
        "l_orderkey", B.range_count(F.col("ranges")).alias("n_blocks"), F.col("ranges")[0]["s"].alias("first_block"),
        F.element_at("ranges", -1)["e"].alias("last_block"), "deleted_timestamp",
    )


@check("parse_body_lines", """SELECT s_nationkey AS report, s_suppkey AS line_no, CAST(s_suppkey AS VARCHAR) AS inode, concat(s_name, ' (deleted)') AS file_name, s_suppkey * 10 AS file_size,
  '1' AS created_timestamp, '3' AS accessed_timestamp, '2' AS modified_timestamp, '4' AS changed_timestamp FROM supplier WHERE s_acctbal > 0""")
def _(spark, d):
    state = F.when(F.col("s_acctbal") > 0, " (deleted)").otherwise("")
    line = F.concat(F.lit("0|"), "s_name", state, F.lit("|"), F.col("s_suppkey").cast("string"), F.lit("|r/rrwx|0|0|"), (F.col("s_suppkey") * 10).cast("string"), F.lit("|1|2|3|4"))
    lines = view(spark, d, "supplier").select(F.col("s_nationkey").alias("report"), F.col("s_suppkey").alias("line_no"), line.alias("line"))
    return P.parse_body_lines(lines, ["report"])


@check("parse_fs_geometry", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'fat16' ELSE 'ext4' END AS fs_type, 512 AS sector_size, CASE s_suppkey % 3 WHEN 0 THEN 4096 WHEN 1 THEN 512 * (s_suppkey % 7 + 1) END AS unit_size,
  CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN s_suppkey % 7 + 1 END AS sectors_per_unit, CASE WHEN s_suppkey % 3 = 1 THEN 2 END AS fats, CASE WHEN s_suppkey % 3 = 2 THEN 'no unit size' END AS reason FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey")
    body = F.when(k % 3 == 0, "File System Type: NTFS\nCluster Size: 4096\n").when(
        k % 3 == 1, F.concat(F.lit("File System Type: FAT16\nSectors Per Cluster: "), (k % 7 + 1).cast("string"), F.lit("\nNumber of FATs: 2\n"))
    ).otherwise("File System Type: Ext4\n")
    reports = view(spark, d, "supplier").select("s_suppkey", F.concat(body, F.lit("Sector Size: 512\n")).alias("text"))
    return P.parse_fs_geometry(reports, ["s_suppkey"]).select("s_suppkey", "fs_type", "sector_size", "unit_size", "sectors_per_unit", "fats", "reason")


@check("hit_blocks", """SELECT c_nationkey AS report, c_custkey * 10 AS line_no, concat('Hit [', CAST(c_custkey AS VARCHAR), ']') AS id, 'Dire Wolf' AS keyword, concat('/a/', c_name) AS file,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(c_name, c_mktsegment) END AS file_line FROM customer
UNION ALL SELECT c_nationkey, c_custkey * 10 + 7, concat('Hit [', CAST(c_custkey AS VARCHAR), ']'), 'kw', 'f.txt', '' FROM customer WHERE c_custkey % 3 <> 0""")
def _(spark, d):
    """One report per nation, a block of eight lines per customer; every third has no dump."""
    k = F.col("c_custkey").cast("string")
    dump = lambda at, t: F.when(F.col("c_custkey") % 3 == 0, "no dump").otherwise(F.concat(F.lit(at), F.lit("  41 42 43  |"), t, F.lit("|")))
    texts = [
        F.concat(F.lit("Hit ["), k, F.lit("]:  Dire Wolf (x) (")), F.lit("note"), F.concat(F.lit("File: /a/"), "c_name"), F.lit(" dd bs=512 skip=1"),
        dump("00000000", F.col("c_name")), dump("00000010", F.col("c_mktsegment")), F.lit("end"), F.concat(k, F.lit(":kw:1:2:f.txt:apfs:utf-8")),
    ]
    rows = F.array(*[F.struct((F.col("c_custkey") * 10 + i).alias("line_no"), t.alias("line")) for i, t in enumerate(texts)])
    lines = view(spark, d, "customer").select(F.col("c_nationkey").alias("report"), F.inline(rows))
    return P.hit_blocks(lines, ["report"])


TOKENS = with_views("ss_gt", "ss_sub") + """,
toks AS (SELECT DISTINCT base_test_case, file_line AS token, lower(trim(type)) AS type FROM ss_gt WHERE lower(trim(type)) IN ('active', 'deleted', 'unallocated')),
hits AS (SELECT s.base_test_case, s.tool_used AS file, s.sub_pos AS line_no, t.token, t.type FROM ss_sub s JOIN toks t ON s.base_test_case = t.base_test_case AND contains(s.line, t.token))"""


def token_frames(spark, d):
    lines = view(spark, d, "ss_sub").select("base_test_case", F.col("tool_used").alias("file"), F.col("sub_pos").alias("line_no"), "line")
    return lines, view(spark, d, "ss_gt")


@check("token_containment", TOKENS + " SELECT * FROM hits")
def _(spark, d):
    lines, gt = token_frames(spark, d)
    tokens = gt.select("base_test_case", F.col("file_line").alias("token"), F.lower(F.trim("type")).alias("type")).filter(F.col("type").isin(*C.SCOPES))
    return C.token_hits(lines, tokens, ["base_test_case"]).drop("line")


@check("token_report_files", TOKENS + """ SELECT t.base_test_case, t.file, s.type, t.n AS total_rows, coalesce(m.n, 0) AS matched_rows, t.n - coalesce(m.n, 0) AS missed_rows
 FROM (SELECT base_test_case, tool_used AS file, count(*) AS n FROM ss_sub GROUP BY ALL) t CROSS JOIN (SELECT unnest(['active', 'deleted', 'unallocated']) AS type) s
 LEFT JOIN (SELECT base_test_case, file, type, count(DISTINCT line_no) AS n FROM hits GROUP BY ALL) m ON m.base_test_case = t.base_test_case AND m.file = t.file AND m.type = s.type""")
def _(spark, d):
    return C.token_report(*token_frames(spark, d), ["base_test_case"])[0]


@check("token_report_types", TOKENS + """, own AS (SELECT base_test_case, token, max(type) AS type FROM toks GROUP BY ALL), f AS (SELECT o.base_test_case, o.type, count(*) AS n FROM own o WHERE EXISTS (SELECT 1 FROM hits h WHERE h.base_test_case = o.base_test_case AND h.token = o.token) GROUP BY ALL)
SELECT t.base_test_case, t.type, coalesce(f.n, 0) AS tp, 0 AS fp, t.n - coalesce(f.n, 0) AS fn FROM (SELECT base_test_case, type, count(*) AS n FROM toks GROUP BY ALL) t LEFT JOIN f USING (base_test_case, type)""")
def _(spark, d):
    return C.token_report(*token_frames(spark, d), ["base_test_case"])[1]


@check("keyword_lines", r"""WITH terms AS (SELECT DISTINCT split_part(text, ' ', 2) AS term FROM benchmark WHERE length(split_part(text, ' ', 2)) > 0),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS l FROM documents))
SELECT doc_id, term, line_no, line FROM lines JOIN terms ON contains(lower(line), lower(term))""")
def _(spark, d):
    terms = view(spark, d, "benchmark").select(F.get(F.split("text", " "), F.lit(1)).alias("term")).filter(F.length("term") > 0).distinct()
    return C.keyword_lines(view(spark, d, "documents"), terms, ["doc_id"])


_HEX_HITS = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS b, unnest(range(0, length(hex(text)) // 2)) AS i FROM documents),
w AS (SELECT doc_id, i, b, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS b2, lead(b, 2) OVER (PARTITION BY doc_id ORDER BY i) AS b3 FROM b)
SELECT doc_id, 'Que' AS term, i AS "offset" FROM w WHERE b IN ('71', '51') AND b2 IN ('75', '55') AND b3 IN ('65', '45')
UNION ALL SELECT doc_id, 'und', i FROM w WHERE b IN ('75', '55') AND b2 IN ('6E', '4E') AND b3 IN ('64', '44')"""


@check("keyword_search_raw", _HEX_HITS)
def _(spark, d):
    blobs = view(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return keyword_search_raw(blobs, ["Que", "und"], "doc_id").drop("snippet")


@check("keyword_search_wide", """SELECT doc_id, 'und' AS term, 2 * (i - 1) + doc_id % 2 AS "offset" FROM (SELECT doc_id, text, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) > 2 AND length(text) = strlen(text)) WHERE substring(text, CAST(i AS BIGINT), 3) = 'und'""")
def _(spark, d):
    """Texts of one-byte letters as UTF-16, little-endian where the id is even; zero bytes stand between the letters."""
    docs = view(spark, d, "documents").filter(F.length("text") == F.octet_length("text"))
    wide = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    found = keyword_search_raw(docs.select("doc_id", wide.alias("content")), ["und"], "doc_id", ignore_case=False)
    # the same letters are met from the zero byte before them too; places of letters are asked for
    return found.filter(F.col("offset") % 2 == F.col("doc_id") % 2).select("doc_id", "term", "offset")


# The bytes of all texts as UTF-16, a letter beyond the basic plane as two units; then the three spellings a keyword is met in, byte by byte:
# as it is, in UTF-16 of either order, and in what remains where a zero byte behind another byte is passed over.
_UNIT = "lpad(hex({0}), 4, '0')"
_TURNED = "concat(substring({0}, 3, 2), substring({0}, 1, 2))"
_LOW, _HIGH, _TAIL = (_UNIT.format(x) for x in ("unicode(c)", "55296 + ((unicode(c) - 65536) >> 10)", "56320 + ((unicode(c) - 65536) & 1023)"))
_WIDE_HITS = f"""WITH coded AS (SELECT doc_id, list_aggregate(list_transform(string_split(text, ''), lambda c: CASE
    WHEN doc_id % 2 = 1 AND unicode(c) < 65536 THEN {_LOW} WHEN doc_id % 2 = 1 THEN concat({_HIGH}, {_TAIL})
    WHEN unicode(c) < 65536 THEN {_TURNED.format(_LOW)} ELSE concat({_TURNED.format(_HIGH)}, {_TURNED.format(_TAIL)}) END), 'string_agg', '') AS h
  FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, unnest(range(0, length(h) // 2)) AS i FROM coded),
near AS (SELECT doc_id, i, b, lag(b) OVER w AS b0, concat(b, lead(b) OVER w, lead(b, 2) OVER w) AS three, concat(lead(b, 3) OVER w, lead(b, 4) OVER w, lead(b, 5) OVER w) AS further FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kept AS (SELECT doc_id, i, concat(b, lead(b) OVER w, lead(b, 2) OVER w) AS three FROM near WHERE b <> '00' OR coalesce(b0, '00') = '00' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, 'und' AS term, i AS "offset" FROM (
  SELECT doc_id, i FROM near WHERE three = '756E64' OR (three = '75006E' AND further = '006400') OR (three = '007500' AND further = '6E0064')
  UNION SELECT doc_id, i FROM kept WHERE three = '756E64')"""


@check("keyword_search_utf16", _WIDE_HITS)
def _(spark, d):
    """All documents as UTF-16, little-endian where the id is even, and every place that is found."""
    docs = view(spark, d, "documents")
    wide = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    return keyword_search_raw(docs.select("doc_id", wide.alias("content")), ["und"], "doc_id", ignore_case=False).select("doc_id", "term", "offset")


CODE = with_views("responses")
STRIP = "trim({0}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12)))"
PY, SH, ANY = (f"CASE WHEN regexp_matches(response, '(?s)```{k}(.*?)```') THEN {STRIP.format(f'''regexp_extract(response, '(?s)```{k}(.*?)```', 1)''')} END" for k in ("python", "bash", ""))


@check("extract_code", CODE + f" SELECT conv_id, turn, coalesce(py, sh, an, '') AS code, CASE WHEN py IS NOT NULL THEN 'python' WHEN sh IS NOT NULL THEN 'bash' WHEN an IS NOT NULL THEN 'generic' ELSE '' END AS kind FROM (SELECT *, {PY} AS py, {SH} AS sh, {ANY} AS an FROM responses)")
def _(spark, d):
    return view(spark, d, "responses").select("conv_id", "turn", F.inline(F.array(extract_code(F.col("response")))))


@check("extract_code_labelled", CODE + f" SELECT conv_id, turn, coalesce(py, sh, an, nullif(trim(regexp_extract(response, 'def |import |class ')), ''), nullif(trim(regexp_extract(response, '#!/bin/bash|echo |sudo |apt-get ')), ''), '') AS code, CASE WHEN py IS NOT NULL THEN 'python' WHEN sh IS NOT NULL THEN 'bash' WHEN an IS NOT NULL THEN 'generic' WHEN regexp_matches(response, 'def |import |class ') THEN 'python' WHEN regexp_matches(response, '#!/bin/bash|echo |sudo |apt-get ') THEN 'bash' ELSE '' END AS kind FROM (SELECT *, {PY} AS py, {SH} AS sh, {ANY} AS an FROM responses)")
def _(spark, d):
    return view(spark, d, "responses").select("conv_id", "turn", F.inline(F.array(extract_code_labelled(F.col("response")))))


@check("classify_script", CODE + f" SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {STRIP.format('response')} = '' THEN NULL WHEN contains(response, 'bash') THEN 'sh' WHEN contains(response, 'python') OR regexp_matches(response, 'def |import ') THEN 'py' ELSE 'txt' END AS kind FROM responses) GROUP BY 1")
def _(spark, d):
    return view(spark, d, "responses").groupBy(classify_script(F.col("response")).alias("kind")).agg(F.count("*").alias("n"))


TEMPLATE = "Task: {prompt} on {DISK_IMAGE_PATH}."


@check("render_prompt", "SELECT item_id, concat('Task: ', text, ' on /img/a.dd.', ' You should provide a python code to achieve this task.  import ') AS rendered FROM benchmark")
def _(spark, d):
    return view(spark, d, "benchmark").select(
        "item_id", render_prompt(F.lit(TEMPLATE), F.col("text"), F.lit("/img/a.dd"), script_suffix(F.lit("python"))).alias("rendered")
    )


@check("prompt_matrix", """WITH p AS (SELECT doc_id AS pos, text AS prompt, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_no FROM documents)
SELECT j.doc_id AS job_id, p.row_no, concat('#', CAST(j.doc_id % 3 AS VARCHAR), ' ', p.prompt, ' @/img You should provide a shell code to achieve this task. #!/bin/bash') AS rendered
FROM documents j JOIN p ON p.source = j.source AND p.row_no <= 5 + j.doc_id % 7""")
def _(spark, d):
    """Every document is a job over the first documents of its own source; three templates."""
    docs = view(spark, d, "documents")
    prompts = docs.select(F.col("doc_id").alias("pos"), F.col("text").alias("prompt"), F.col("source").alias("disk_image"))
    jobs = docs.select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("disk_image"), F.lit("/img").alias("disk_image_path"),
        (F.col("doc_id") % 3).alias("base_prompt_id"), (F.col("doc_id") % 7 + 5).alias("take_in_test_count"), F.lit("shell").alias("script_type"),
    )
    templates = view(spark, d, "region").select((F.col("r_regionkey") % 3).cast("bigint").alias("base_prompt_id")).distinct().withColumn(
        "template", F.concat(F.lit("#"), F.col("base_prompt_id").cast("string"), F.lit(" {prompt} @{DISK_IMAGE_PATH}"))
    )
    return R.prompt_matrix(prompts, templates, jobs).select("job_id", "row_no", "rendered")


@check("first_n_prompts", "SELECT source, doc_id, row_no FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_no FROM documents) WHERE row_no <= 25")
def _(spark, d):
    return R.first_n_prompts(view(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 25)


OUTPUT = """WITH o AS (SELECT user_id, event_type, value, CASE event_id % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'active' WHEN 2 THEN 'unallocated' ELSE 'bad' END AS s, event_id FROM events)"""


def script_outputs(spark, d):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "deleted").when(k == 1, " active ").when(k == 2, "unallocated").otherwise("a,b")
    line = F.concat(F.lit("/p/"), F.col("event_id").cast("string"), F.lit(","), status)
    return view(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.array_join(F.collect_list(line), "\n").alias("output"), F.max("value").alias("top")
    )


@check("status_hits", OUTPUT + " SELECT user_id, event_type, count(*) FILTER (s = 'active') AS active_hits, count(*) FILTER (s = 'deleted') AS deleted_hits, count(*) FILTER (s = 'unallocated') AS unallocated_hits FROM o GROUP BY ALL")
def _(spark, d):
    return R.status_hits(script_outputs(spark, d), ["user_id", "event_type"])


@check("job_summary", OUTPUT + """, runs AS (SELECT user_id % 10 AS job_id, CASE WHEN user_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, event_type AS base_test_case, count(*) FILTER (s = 'active') AS a, count(*) FILTER (s = 'deleted') AS d, count(*) FILTER (s = 'unallocated') AS u, max(value) > 150 AS failed FROM o GROUP BY user_id, event_type)
SELECT *, success_executions * 100 / total_executions AS success_percentage, error_executions * 100 / total_executions AS error_percentage FROM (SELECT job_id, model, base_test_case, CAST(sum(a) AS BIGINT) AS active_count, CAST(sum(d) AS BIGINT) AS deleted_count, CAST(sum(u) AS BIGINT) AS unallocated_count,
 count(*) FILTER (NOT failed) AS success_executions, count(*) FILTER (failed) AS error_executions, count(*) AS total_executions, count(*) FILTER (a + d + u > 0) AS keywords_found FROM runs GROUP BY job_id, model, base_test_case)""")
def _(spark, d):
    outputs = script_outputs(spark, d)
    error = F.when(F.col("top") > 150, "Timeout").otherwise("")
    hits = R.status_hits(outputs.withColumn("error", error), ["user_id", "event_type", "error"])
    return R.job_summary(hits.select(
        (F.col("user_id") % 10).alias("job_id"), F.when(F.col("user_id") % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.col("event_type").alias("base_test_case"), *[f"{s}_hits" for s in R.STATUSES], "error",
    ))
