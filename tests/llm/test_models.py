"""Language identification, toxicity and the language model: held-out quality, exact
parts against plain versions, and the cases that must not crash."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import language, maxent, toxicity
from tallyweave.llm.common import held_out

LEXICON = {"en": ["the", "house", "with", "over", "thing", "which"], "de": ["und", "haus", "schön", "nicht", "ich", "über"], "fr": ["être", "maison", "où", "avec", "français", "les"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LEXICON))
        text = [rng.choice(LEXICON[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(4, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "Rotter!", "blockhead"]))
        rows.append((i, " ".join(text), lang, toxic))
    return rows


def odd_cases():
    return [(900, None, None), (901, "", "en"), (902, " 12 !? ", "de"), (903, "the " * 5000, None), (None, "haus und", "de"), (7, "repeated row", "en"), (7, "repeated row", "en")]


@pytest.fixture(scope="module")
def rows():
    return corpus(400, 1)


def test_language(spark, rows):
    docs = spark.createDataFrame([(i, t, g, 1.0) for i, t, g, _ in rows] + [(*c, 2.0) for c in odd_cases()], "doc_id bigint, text string, lang string, lang_score double")
    out = held_out(F.col("doc_id"), 5, 0)
    found = language.identify(docs, language.fit(docs, ~out))
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"]
    got = found.collect()
    truth = {i: g for i, _, g, _ in rows}
    fresh = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id != 7]
    assert sum(r.lang_pred == truth[r.doc_id] for r in fresh) >= 0.95 * len(fresh)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].lang_score == 0 for k in (900, 901, 902))
    assert all(0 <= r.lang_score <= 1 for r in got) and len(got) == docs.count()
    assert language.identify(docs, {}).first().lang_pred == "und"
    assert language.identify(docs.limit(0), language.fit(docs.limit(0), ~out)).count() == 0


def test_toxicity(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(i, t, "x") for i, t, _ in odd_cases()], "doc_id bigint, text string, toxic_score string")
    labels = spark.createDataFrame([(i, 1, y) for i, *_, y in rows] + [(3, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels, ~out)).collect()
    truth = {i: (t, y) for i, t, _, y in rows}
    fresh = [r for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.toxic_predicted == truth[r.doc_id][1] for r in fresh) >= 0.97 * len(fresh)
    for r in found:
        assert 0 <= r.toxic_score <= 1
        for s in r.toxic_spans:
            assert r.text[s.start : s.end].strip("!").lower() in ("scoundrel", "rotter", "blockhead")
    kept = toxicity.remove_toxic(docs, toxicity.fit(docs, labels, ~out))
    assert kept.columns == docs.columns and kept.where("doc_id = 900").count() == 1
    none = toxicity.fit(docs, labels.limit(0), ~out)
    assert toxicity.score(docs, none).where("toxic_predicted = 1").count() == 0


def test_marginals_equal_every_path():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 6])
    starts, local, move = np.cumsum(sizes) - sizes, rng.normal(size=11), rng.normal(size=(2, 2))
    _, _, p = toxicity.marginals(local, starts, sizes, move)
    for s, n in zip(starts, sizes):
        total, on = 0.0, np.zeros(n)
        for k in range(2**n):
            y = [(k >> t) & 1 for t in range(n)]
            w = math.exp(sum(local[s + t] * y[t] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[s : s + n], on / total)


def test_language_model(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 20)  # most words go through the join
    monkeypatch.setattr(maxent, "ITEMS", 12)
    texts = [(i, t) for i, t, *_ in rows] + [(i, t) for i, t, _ in odd_cases()]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id bigint, text string, n_tokens int")
    out = held_out(F.col("doc_id"), 7, 2)
    counts, lexicon, model = maxent.fit(docs, ~out)
    got = maxent.score(docs, counts, lexicon, model).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    train = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words(t))
    n, v = sum(train.values()), len(train)
    assert (lexicon.total, lexicon.distinct, len(got)) == (n, v, len(texts))
    want = sorted((len(words(t)), sum(w in train for w in words(t)), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for _, t in texts)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    known = {i for i, *_ in rows}
    fresh = [r for r in got if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.lm_score for r in fresh) > sum(r.base_score for r in fresh)
    empty = maxent.fit(docs.limit(0), ~out)
    assert maxent.score(docs.limit(3), *empty).count() == 3


def small_model():
    lexicon = maxent.Lexicon([b"a", b"bb", b"ccc"], np.array([9, 5, 4]), 4, 18, 3)
    rng = np.random.default_rng(0)
    leaf = maxent.leaves(rng.integers(0, 9, (len(lexicon), maxent.NEAR_WORDS)), rng.integers(1, 99, len(lexicon)))
    model = maxent.Model(lexicon, leaf, np.ones(len(lexicon)), np.zeros(maxent.ENDINGS), np.zeros(maxent.ENDINGS))
    model.weights[:] = rng.normal(size=model.weights.shape)
    return lexicon, model


def test_language_model_is_a_distribution():
    lexicon, model = small_model()
    assert len(set((maxent.BRANCH ** np.arange(maxent.LEVELS) @ model.digit).tolist())) == len(lexicon)
    keys = model.keys(np.array([7, 8, 9], np.uint32), np.array([3]))
    for token in range(3):
        every = np.repeat(keys[:, token : token + 1], len(lexicon), axis=1)
        assert np.exp(model.log_item(every, np.arange(len(lexicon)))).sum() == pytest.approx(1, rel=1e-4)


def test_gradient_is_the_slope_of_the_likelihood():
    lexicon, model = small_model()
    rng = np.random.default_rng(1)
    item = rng.integers(0, len(lexicon), 40)
    keys = model.keys((item << 20).astype(np.uint32), np.array([25, 15]))
    at, g = model.gradient(keys, item)
    for row, child in ((0, 0), (len(at) // 2, 5), (len(at) - 1, maxent.BRANCH - 1)):
        before = model.weights[at[row], child]
        ends = []
        for step in (-0.01, 0.01):
            model.weights[at[row], child] = before + step
            ends.append(model.log_item(keys, item).sum())
        model.weights[at[row], child] = before
        assert g[row, child] == pytest.approx((ends[1] - ends[0]) / 0.02, abs=2e-2)


def test_score_is_the_sum_over_tokens(spark):
    """The whole text's score from one token at a time, words beyond the head included."""
    texts = ["a bb ccc", "a rare bb rare", "", None, "a"]
    lexicon, model = small_model()
    counts = spark.createDataFrame([(bytearray(b"a"), 9), (bytearray(b"bb"), 5), (bytearray(b"ccc"), 4), (bytearray(b"rare"), 2)], "word binary, n bigint")
    docs = spark.createDataFrame(list(enumerate(texts)), "`doc``id` bigint, text string").withColumn("N_Tokens", F.lit("x"))
    got = {r[0]: r.lm_score for r in maxent.score(docs, counts, lexicon, model).collect()}
    reader, count = maxent.Reader(lexicon), {b"a": 9, b"bb": 5, b"ccc": 4, b"rare": 2}
    for k, t in enumerate(texts):
        words = maxent.tokens((t or "").encode())
        ids, _ = reader.read([(t or "").encode()])
        numbers, total = reader.number[ids], 0.0
        for at, w in enumerate(words):
            keys = model.keys(numbers[: at + 1], np.array([at + 1]))[:, -1:]
            item = maxent.item_of(numbers[at : at + 1])
            total += (model.log_item(keys, item)[0] + model.log_below[item[0]]) / math.log(10)
            total += math.log10(count.get(w, 0) + 1) if item[0] >= lexicon.n_own else 0
        assert got[k] == pytest.approx(total, abs=1e-4)


def test_equal_hashes_are_told_apart_by_the_word(monkeypatch):
    monkeypatch.setattr(maxent.xxhash, "xxh64_intdigest", lambda w, seed: 7)
    lexicon = maxent.Lexicon([b"x", b"y"], np.array([3, 2]), 2, 5, 2)
    reader = maxent.Reader(lexicon)
    ids, _ = reader.read([b"y z x"])
    assert reader.count[ids].tolist() == [2, -1, 3, -1]


def test_long_chains_in_blocks_give_the_same_marginals(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 5000, 7, 2048, 0, 1025, 3])
    starts = np.cumsum(sizes) - sizes
    local, move = rng.normal(-1, 4, sizes.sum()), np.array([[0.4, -2.0], [-0.3, 1.5]])
    cut = toxicity.marginals(local, starts, sizes, move)
    monkeypatch.setattr(toxicity, "BLOCK", 10**6)
    for a, b in zip(cut, toxicity.marginals(local, starts, sizes, move)):
        assert np.allclose(a, b, rtol=1e-9, atol=0)


def test_long_texts_are_scored_whole_and_cost_the_driver_little(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    rng = random.Random(2)
    plain = lambda n: " ".join(f"word{rng.randint(0, 300)}" for _ in range(n))
    docs = [(k, f"{plain(25)} {'grumblefoo' if k % 2 else 'fine'} {plain(25)}") for k in range(200)]
    filler = plain(200_000)
    docs += [(201, filler), (203, f"{filler} grumblefoo {filler}")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k, _ in docs], "doc_id bigint, toxic int")
    chain = toxicity.fit(frame, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(frame, chain).collect()}
    assert got[203].toxic_score > got[201].toxic_score
    assert [s.start for s in got[203].toxic_spans] == [len(filler) + 1] and got[201].toxic_spans == []


def test_slices_and_forgotten_words_change_no_score(spark, monkeypatch):
    """Scoring holds a bounded number of tokens and words at a time, whatever the table."""
    texts = [f"w{k} w{k % 7} bad{k % 3} good, w{k * 5} " * (k % 4) for k in range(60)] + ["", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    chain = toxicity.train([t.encode() for t in texts if t], [int("bad1" in t) for t in texts if t], [1.0] * sum(map(bool, texts)))
    whole = toxicity.score(docs, chain).orderBy("doc_id").collect()
    monkeypatch.setattr(toxicity, "SCORED_BYTES", 100)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 5)
    assert toxicity.score(docs, chain).orderBy("doc_id").collect() == whole
    assert len({r.toxic_score for r in whole}) > 1
