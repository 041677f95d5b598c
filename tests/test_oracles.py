"""A few registered queries beside their SQL oracles on the smallest tables (all of them: tools/compare.py)."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from exhume.checks.fixtures import TABLES
from tools.compare import rows

DATA = "/root/testdata/sf0.001"
NAMES = [
    "string_search_score", "registry_score", "sqlite_score", "dfr_score", "dfr_details", "aligned_match_stats", "byte_compare_lockstep",
    "nearest_original", "sector_to_partition", "merge_gt_blocks", "keyword_lines", "to_epoch", "upsert_summary",
]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    rel = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
