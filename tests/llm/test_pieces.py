import os
import random

import pytest

from tallyweave.llm import pieces as P

TEXTS = ["", " ", "  a b\n\nc\tT  ", "a▁b  ", "▁", "ﬁ Ａ　x😀日本語 tokenization", "\n", "x" * 300 + "  " * 40, "The quick brown Fox jumps over 12,345.67 dogs!", "é" * 50, "ab\r\ncd ef"]
HERE = os.path.exists(P.MODEL_PATH)


def best(text, vocabulary):
    """The largest score by trying every path; bytes cost more than any piece."""
    best_at = [(0.0, ())] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if best_at[start] is not None and text[start:end] in vocabulary:
                score = best_at[start][0] + vocabulary[text[start:end]]
                if best_at[end] is None or score > best_at[end][0]:
                    best_at[end] = (score, best_at[start][1] + (text[start:end],))
    return best_at[-1]


def test_unigram_equals_every_path():
    letters = {c: -5.0 - k for k, c in enumerate("▁abc")}
    longer = {"▁a": -3.0, "ab": -3.5, "bc": -2.0, "abc": -9.0, "▁ab": -8.0, "cab": -4.25, "aa": -6.5}
    names = ["<unk>", *letters, *longer]
    scores = [0.0, *letters.values(), *longer.values()]
    model = P.Model(names, scores, [P.UNKNOWN] + [P.NORMAL] * (len(names) - 1), bpe=False)
    encoder = P.Encoder(model)
    for text in ["abcabc", "aab cab", "a", "ccc  ab", "bcbcaabc"]:
        ids = encoder.encode(text)
        stretch = ("▁" + text).replace(" ", "▁")
        assert sum(scores[i] for i in ids) == pytest.approx(best(stretch, {**letters, **longer})[0])
        assert P.Decoder(model).decode(ids) == text


@pytest.mark.skipif(not HERE, reason="needs the public model file")
def test_equals_the_library_and_comes_back():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.MODEL_PATH)
    model = P.Model.read(P.MODEL_PATH)
    encoder, decoder = P.Encoder(model), P.Decoder(model)
    for text in TEXTS:
        ids = encoder.encode(text)
        assert decoder.decode(ids) == text
        if "▁" not in text:
            assert ids.tolist() == library.encode(text)


@pytest.mark.skipif(not HERE, reason="needs the public model file")
def test_random_stretches_have_a_path_and_equal_the_library():
    """The pass over known characters always arrives, so that plain merging is never needed."""
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.MODEL_PATH)
    encoder, rng = P.Encoder(P.Model.read(P.MODEL_PATH)), random.Random(3)
    pool = [p for p in encoder.ids if 1 < len(p) < 9]
    few = sorted(encoder.chars - {P.BLANK})
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) if rng.random() < 0.7 else "".join(rng.choice(few[: rng.choice([30, 200])]) for _ in range(rng.randint(1, 40)))
        assert encoder._by_neighbours(text) is not None
        text = text.replace(P.BLANK, " ")
        assert encoder.encode(text).tolist() == library.encode(text), text


@pytest.mark.skipif(not HERE, reason="needs the public model file")
def test_columns(spark):
    model = P.Model.read(P.MODEL_PATH)
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(TEXTS)] + [(99, None, None), (0, "", "kept")], "doc_id bigint, text string, decoded string")
    back = P.decode(P.encode(docs, model), model)
    assert back.columns == ["doc_id", "text", "piece_ids", "decoded"]
    for r in back.collect():
        assert r.decoded == r.text and (r.piece_ids is None) == (r.text is None)
    checked = P.encode(docs, model, check=True).collect()
    assert all(r.round_trip is (None if r.text is None else True) for r in checked)
    odd = spark.createDataFrame([(1, [5, None, 10**6, -4]), (2, None), (3, [])], "doc_id bigint, piece_ids array<int>")
    assert [r.decoded for r in P.decode(odd, model).orderBy("doc_id").collect()][1:] == [None, ""]
    assert P.encode(docs.limit(0), model).count() == 0
