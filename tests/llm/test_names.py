"""Other columns may have any names, and operators and stages give them back."""

import pytest

import corpus_pipeline
from tallyweave.llm import decontaminate, language, licenses, maxent, pieces, pii, quality, simhash, toxicity

ODD = ["a.b", "__in0", "__c1", "back`tick", "Toxic_Score", "HIT_SPANS", "license_LABELS", "Lang_Pred", "PIECE_ids", "fingerPrint", "Kept", "__New0"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "the first text of all with the apache license in it", "call me at +1 212 555 1234 or write to me@example.org now", "the first text of all with the apache license in it"] + [f"plain words number {k} stand here and there in a row of words" for k in range(15)]
    rows = [(k, t, "en" if k % 2 else "fr", "s", len(t or ""), *[f"{n}{k}" for n in ODD]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *ODD])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "plain words number 3 stand here and there in a row")], "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def odd_of(rows, names):
    return sorted(tuple(r[rows[0].__fields__.index(n)] for n in names) for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, folder, name, stage):
    out = stage(spark, docs, folder)
    kept = [c for c in docs.columns if name != "encode" or c != "PIECE_ids"]
    assert [c for c in out.columns if c in kept] == kept
    rows, given = out.collect(), {r["doc_id"]: r for r in docs.collect()}
    for r in rows:
        for n in ODD:
            if n in kept:
                assert r[out.columns.index(n)] == given[r["doc_id"]][docs.columns.index(n)]
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_operators(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    every = labels["doc_id"].isNotNull()
    made = {
        "toxic_score": toxicity.score(docs, toxicity.fit(docs, labels, every)),
        "hit_spans": decontaminate.find_contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")),
        "license_labels": licenses.scan(docs),
        "lang_pred": language.identify(docs, language.fit(docs, docs["doc_id"] >= 0)),
        "piece_ids": pieces.encode(docs, pieces.Model.read(pieces.MODEL_PATH)),
        "fingerprint": simhash.with_fingerprint(docs),
        "kept": quality.judge(docs),
        "lm_score": maxent.fit_and_score(docs, docs["doc_id"] >= 0)[0],
        "pii_spans": pii.with_spans(pii.with_candidates(docs), pii.fit([])),
    }
    for new, frame in made.items():
        assert [c.lower() for c in frame.columns].count(new) == 1, new
        assert len(frame.collect()) == 20
        assert {"a.b", "__in0", "back`tick"} <= set(frame.columns), new
