"""Queries with SQL give that SQL's rows; the pipeline's stages take effect one after the other."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle_check import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from epigrain.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SMALL), name, QUERIES[name], ORACLES[name], SMALL) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "123 456", "en", "s", 7)], docs.schema)
    kept = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = kept.count(), stage(spark, kept, SMALL).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= before
        assert after.exceptAll(kept).isEmpty()
        if name == "language":
            assert after.where("doc_id > 900000").isEmpty()
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.count() > 0


def test_each_stage_stands_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_one_row_of_each_group_stays_without_good_ids(spark, documents):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcd"]
    rows = [(None, texts[0])] * 3 + [(7, texts[1]), (7, texts[2]), (3, texts[1]), (None, texts[2]), (None, texts[3]), (9, texts[3] + " end")]
    got = corpus_pipeline.keep_one_of_each_group(spark, documents(rows), SMALL)
    want = [(None, texts[0]), (3, texts[1]), (7, texts[2]), (9, texts[3] + " end")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    good = corpus_pipeline.keep_one_of_each_group(spark, documents([(1, texts[0]), (2, texts[0]), (5, texts[1])]), SMALL)
    assert sorted(r.doc_id for r in good.collect()) == [1, 5]
