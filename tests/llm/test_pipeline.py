"""The pipeline's stages, each on what its predecessor kept."""

import os

import pytest

import corpus_pipeline
from tallyweave.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the stored tables")


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        ids = set(left)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert 0.5 * before < docs.count() < before
    assert docs.where("size(piece_ids) > 0").count() == docs.where("text <> ''").count()
    assert docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count() == 0


#: Queries whose rows are phrases, and anchors with their negatives.
OTHER_ROWS = {"op11_collocations", "op12_hard_negatives"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER_ROWS))
def test_queries_return_every_row(spark, name):
    rows = queries.QUERIES[name](spark, DATA).count()
    table = "pages" if name == "op9_warc" else "documents"
    assert rows == spark.read.parquet(f"{DATA}/{table}.parquet").count()
