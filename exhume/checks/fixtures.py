"""Views over the test tables in the shapes the operators take.

Each view is one SQL text valid in Spark and in the SQL oracle, over whole tables: submissions are
ground truth with some *values* changed, never a subset of rows. ``view`` gives the DataFrame,
``with_views`` the same definitions as a WITH clause.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["ss_gt"] = """
SELECT concat('SS-', event_type) AS base_test_case,
  CASE WHEN user_id % 2 = 0 THEN 'windows' ELSE 'linux' END AS os,
  lpad(CAST(event_id % 10000 AS VARCHAR(20)), 4, '0') AS file_line,
  CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'Deleted' WHEN 2 THEN 'unalloc'
       WHEN 3 THEN 'unalocated' ELSE 'unallocated' END AS type,
  event_id AS gt_pos
FROM events"""

VIEWS["ss_sub"] = """
SELECT concat('SS-', event_type) AS base_test_case,
  CASE WHEN user_id % 2 = 0 THEN 'windows' ELSE 'linux' END AS os,
  CASE WHEN event_id % 2 = 0 THEN 'tool_a' ELSE 'tool_b' END AS tool_used,
  concat('ASCII ====> ', event_type, ' ',
    CASE WHEN event_id % 11 = 0 THEN 'none'
         ELSE lpad(CAST((event_id + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) % 10000 AS VARCHAR(20)), 4, '0') END,
    ' <==== x') AS line,
  event_id AS sub_pos
FROM events"""

VIEWS["dfr_files"] = """
SELECT l.*, l_orderkey * 64 + rn AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS rn,
    {days_l_shipdate} * 86400 AS mtime
  FROM lineitem) l"""

VIEWS["dfr_gt"] = """
SELECT concat('DFR-', CAST(l_suppkey % 48 AS VARCHAR(20))) AS base_test_case,
  concat('F', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(rn AS VARCHAR(20)), '.TXT') AS file_name,
  CAST(l_quantity AS BIGINT) * 512 AS size,
  mtime AS modified_timestamp, mtime + l_linenumber AS accessed_timestamp,
  mtime + l_suppkey AS changed_timestamp,
  concat(CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_partkey + CAST(l_quantity AS BIGINT) % 8 AS VARCHAR(20))) AS dfr_blocks,
  pos AS gt_pos
FROM dfr_files"""

VIEWS["dfr_sub"] = """
SELECT concat('DFR-', CAST(l_suppkey % 48 AS VARCHAR(20))) AS base_test_case,
  concat('tool_', lower(l_linestatus)) AS tool_used,
  CASE l_suppkey % 8 WHEN 0 THEN 'NO_OVERWITE_TESTS' WHEN 1 THEN 'FILE_SIZE_TESTS'
    WHEN 2 THEN 'SPECAIL_NTFS_TEST' WHEN 3 THEN 'NON_LATIN_CHAR_TETS' WHEN 4 THEN 'OVERWITE_TESTS'
    WHEN 5 THEN 'MAC_TIME_TESTS' WHEN 6 THEN 'SPECAIL_OBJECTS_TESTS' ELSE 'RECYCLE_DEL_TESTS' END AS test_set,
  CASE l_suppkey % 3 WHEN 0 THEN 'FAT' WHEN 1 THEN 'NTFS' ELSE 'EXT' END AS file_system,
  concat(CASE WHEN pos % 10 = 0 THEN 'lost/X' WHEN pos % 4 = 0 THEN '_' ELSE 'F' END,
    CAST(l_orderkey AS VARCHAR(20)), '-', CAST(rn AS VARCHAR(20)), '.TXT') AS file_name,
  CAST(CAST(l_quantity AS BIGINT) * 512 + CASE WHEN pos % 5 = 0 THEN 512 ELSE 0 END AS VARCHAR(20)) AS file_size,
  CAST(mtime + CASE WHEN pos % 6 = 0 THEN 60 ELSE 0 END AS VARCHAR(20)) AS modified_timestamp,
  CAST(mtime + l_linenumber AS VARCHAR(20)) AS accessed_timestamp,
  CAST(mtime + l_suppkey AS VARCHAR(20)) AS changed_timestamp,
  '0' AS deleted_timestamp,
  CASE WHEN pos % 9 = 0 THEN ''
    WHEN pos % 6 = 0 THEN concat(CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_partkey + CAST(l_quantity AS BIGINT) % 8 AS VARCHAR(20)), ', ', CAST(900000 + l_partkey AS VARCHAR(20)))
    WHEN pos % 7 = 0 THEN concat('[', CAST(l_partkey + 1 AS VARCHAR(20)), ', ', CAST(l_partkey + 2 AS VARCHAR(20)), ']')
    WHEN pos % 8 = 0 THEN concat(CAST(l_partkey + CAST(l_quantity AS BIGINT) % 8 AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)))
    ELSE concat(CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_partkey + CAST(l_quantity AS BIGINT) % 8 AS VARCHAR(20))) END AS blocks,
  pos AS sub_pos
FROM dfr_files"""

VIEWS["reg_gt"] = """
SELECT concat('WR-', CAST(o_custkey % 10 AS VARCHAR(20))) AS base_test_case,
  concat('HKLM', chr(92), 'Software', chr(92), CASE WHEN o_custkey % 37 = 0 THEN 'file_info ' ELSE '' END,
         CAST(o_custkey AS VARCHAR(20))) AS path,
  o_orderpriority AS value
FROM orders"""

VIEWS["reg_sub"] = """
SELECT base_test_case, concat('tool_', CAST(o_custkey % 2 AS VARCHAR(20))) AS tool_used, path, value FROM (
SELECT o_custkey, concat('WR-', CAST(o_custkey % 10 AS VARCHAR(20))) AS base_test_case,
  concat(' HKLM', chr(92), 'Software', chr(92), CASE WHEN o_custkey % 37 = 0 THEN 'file_info ' ELSE '' END,
         CAST(o_custkey AS VARCHAR(20)), ' ') AS path,
  CASE WHEN o_orderstatus = 'P' THEN concat(o_orderpriority, '?') ELSE o_orderpriority END AS value
FROM orders) t"""

VIEWS["attr_gt"] = """
SELECT p_partkey, 'name' AS k, p_name AS v FROM part
UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR(20)) FROM part
UNION ALL SELECT p_partkey, 'brand', CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END FROM part"""

VIEWS["attr_sub"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND k = 'brand' THEN 'extra' ELSE k END AS k,
  CASE WHEN p_partkey % 7 = 0 THEN upper(v) WHEN p_partkey % 11 = 0 THEN concat('zz', v)
  WHEN p_partkey % 13 = 0 THEN 'wrong' WHEN k = 'size' AND p_partkey % 3 = 0 THEN concat(v, '.0') ELSE v END AS v
FROM attr_gt"""

VIEWS["pos_gt"] = """
SELECT l_orderkey, CAST(rn AS BIGINT) AS gt_pos,
  CASE WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) END AS file_line
FROM dfr_files"""

VIEWS["pos_sub"] = """
SELECT l_orderkey, CAST(rn - 1 AS BIGINT) AS pos,
  CAST(CAST(l_quantity AS BIGINT) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS VARCHAR(20)) AS predicted
FROM dfr_files
UNION ALL SELECT l_orderkey, CAST(max(rn) AS BIGINT), 'extra' FROM dfr_files GROUP BY l_orderkey"""

VIEWS["carved"] = """
SELECT doc_id AS file_id, text AS orig_text,
  CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 65)
    WHEN 2 THEN substring(text, 1, length(text) - 10)
    WHEN 3 THEN replace(text, 'qu', 'QU')
    ELSE concat('0123456789abcdef', text) END AS carved_text
FROM documents"""

VIEWS["ranges"] = """
SELECT base_test_case, file_name, size, gt_pos,
  concat(CAST(lo * 8 + 63 AS VARCHAR(20)), '-', CAST((hi + 1) * 8 + 62 AS VARCHAR(20)), ', ', CAST(hi * 8 + 200 AS VARCHAR(20))) AS sector_ranges,
  lo, hi
FROM (SELECT concat('DFR-', CAST(l_suppkey % 48 AS VARCHAR(20))) AS base_test_case,
    concat('F', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(rn AS VARCHAR(20)), '.TXT') AS file_name,
    CAST(l_quantity AS BIGINT) * 512 AS size, pos AS gt_pos,
    l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) % 8 AS hi FROM dfr_files) t"""

VIEWS["responses"] = """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Sure:', chr(10), '```python', chr(10), 'import os', chr(10), text, chr(10), '```', chr(10), 'Done')
  WHEN 1 THEN concat('```bash', chr(10), text, chr(10), '```') WHEN 2 THEN concat('x ```', chr(10), text, chr(10), '``` y') ELSE text END AS response
FROM conversations"""

DEPENDS: dict[str, tuple[str, ...]] = {
    "dfr_gt": ("dfr_files",),
    "dfr_sub": ("dfr_files",),
    "attr_sub": ("attr_gt",),
    "pos_gt": ("dfr_files",),
    "pos_sub": ("dfr_files",),
    "ranges": ("dfr_files",),
}

_SPARK = {"days_l_shipdate": "CAST(datediff(CAST(l_shipdate AS DATE), DATE '1970-01-01') AS BIGINT)"}
_ORACLE = {"days_l_shipdate": "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)"}


def _text(name: str, words: dict[str, str]) -> str:
    sql = VIEWS[name]
    for key, value in words.items():
        sql = sql.replace("{" + key + "}", value)
    return sql


def _order(names: tuple[str, ...]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, ()):
            visit(dep)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(*names: str) -> str:
    """WITH clause (without a trailing comma) defining the named views for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({_text(n, _ORACLE)})" for n in _order(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view as DataFrame; the tables it names are read from ``sf_dir``, and views it is made of from ``made`` where they are written already."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    made = made or {}
    ctes = ",\n".join(f"{n} AS ({_text(n, _SPARK)})" for n in _order((name,)) if n not in made)
    sql = f"WITH {ctes} SELECT * FROM {name}"
    for t in TABLES:
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    for n, rows in made.items():
        written = f"{n}_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(written)
        sql = sql.replace(f"FROM {n}", f"FROM {written}")
    return spark.sql(sql)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
