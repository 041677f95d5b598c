"""The registered queries beside their SQL on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import re
from html import unescape
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from exhume.llm import near_duplicates, queries
from exhume.session import Scratch
from tools.compare import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    rel = db.execute(queries.ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, rel.fetchall())


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language_id(spark, DATA).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_quality_on_held_out_documents(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.op3_quality_classifier(spark, data).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_main_text_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op8_html_extraction(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_stages_follow_each_other(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.write(stage(spark, docs, DATA))
        seen.append((name, docs, after))
        docs = after
    for name, before, after in seen[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS)
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
    stages = {name: (before, after) for name, before, after in seen}
    before, after = stages["line_dedup"]
    assert before.count() == after.count() and after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
    before, after = stages["ngram_jaccard_join"]
    judged = near_duplicates.near_duplicates(before)
    first = {r.class_id for r in judged.filter("class is not null").collect()} | {r.key for r in judged.filter("class is null").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == first
    # what is left has no near copies and no benchmark windows any more
    assert near_duplicates.near_duplicates(after).agg(F.max("n_links")).first()[0] == 0
    _, clean = stages["decontamination"]
    packed = stages["best_fit_packing"][1]
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
