"""The pipeline: each stage against its input, defined results, and queries against their SQL."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skucast.llm import queries
from tests.conftest import SF001
from tests.llm.test_dart import brute
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    res = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF001, duck(SF001))
    assert res["ok"], res


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_stages_on_real_tables(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF001), "test")
        assert out.columns == columns and 0 < out.count() <= docs.count()
        assert out.subtract(docs).count() == 0
        if name == "near_dedup":
            want = sorted({c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()])})
            assert sorted(r.doc_id for r in out.collect()) == want
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_columns_with_clashing_names_pass_through(spark):
    extra = {n: f"'{n}'" for n in ("_hash", "_score", "text_hash", "kept", "score", "node", "bands", "n_words", "group", "_id", "picked")}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(40).selectExpr("*", *[f"{v} AS `{n}`" for n, v in extra.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and out.count() > 0
        assert out.select(*extra).distinct().collect() == [tuple(extra)]
    assert corpus_pipeline.best_fit_packing(spark, docs, SF001).count() >= 40


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(70))
    rows = [(None, long, None, None, None), (1, None, "en", "s", 0), (2, long, "en", "s", 1), (2, long, "en", "s", 1),
            (2, " ".join(f"other{i}" for i in range(90)), "en", "s", 2), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, SF001)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "2", "None"]
    single = corpus_pipeline.near_dedup(spark, docs, SF001)
    got = sorted((str(r.doc_id), len(r.text or "")) for r in single.collect())
    assert got == sorted([("1", 0), ("2", len(long)), ("2", len(rows[4][1]))])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF001).count() == 0
