"""The n-gram similarity join against all pairs."""

import random

import numpy as np
import pytest

from tallyweave.llm import triejoin as J


def grams(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def made_rows(seed, copies=(0, 1, 3, 12)):
    """Originals, copies with up to six changed words, copies of copies, a common opening."""
    rng, texts = random.Random(seed), ["", " \n", "one two", "ONE  two", "one", "one two three", "one two three four"]
    word = lambda: f"w{rng.randint(0, 3000)}"
    opening = [word() for _ in range(60)]
    for k in range(40):
        texts.append(" ".join((opening if k % 4 == 0 else []) + [word() for _ in range(rng.choice([12, 60, 150, 400]))]))
        for _ in range(rng.choice(copies)):
            words = rng.choice(texts[-3:]).split()
            for _ in range(rng.randint(0, 6) if words else 0):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    rows = [*enumerate(texts), (None, "one two three four"), (None, None), (7000, None), (5, texts[5]), (5, texts[5])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shard, counted", [(1, J.SHARD_TOKENS, J.COUNTED), (2, 700, 1.0), (3, 2500, 0.0)])
def test_equals_all_pairs(spark, monkeypatch, seed, shard, counted):
    monkeypatch.setattr(J, "SHARD_TOKENS", shard)  # a small one deals shards out in chunks
    monkeypatch.setattr(J, "COUNTED", counted)
    monkeypatch.setattr(J, "SLICE_BYTES", 2000)
    rows = made_rows(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, `a.b` string, N int").repartition(3)
    got = J.with_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_one_group_of_many_copies_and_a_passage_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARD_TOKENS", 20_000)
    rng = random.Random(4)
    first = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    passage = [f"p{k}" for k in range(50)]
    rows = []
    for k in range(300):
        words = list(first)
        words[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(words)))
        rows.append((1000 + k, " ".join(passage + [f"m{rng.randint(0, 99999)}" for _ in range(25)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in J.with_components(docs).collect()), key=repr) == plain(rows)


def test_trie_alone_equals_all_pairs():
    rng = np.random.default_rng(6)
    for trial in range(30):
        base = [np.unique(rng.integers(0, 400, rng.integers(1, 60))) for _ in range(6)]
        sets = {}
        for _ in range(40):
            own = base[rng.integers(6)].copy()
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = rng.integers(0, 400)
            own = np.unique(own).astype(np.uint64)
            sets[own.tobytes()] = own
        sets = list(sets.values())
        labels = np.arange(len(sets)) if trial % 2 else rng.integers(0, 5, len(sets))

        def joined(links):
            root = labels.copy()
            for a, b in links:
                root[root == root[a]] = root[b]
            return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

        every = [(a, b) for a in range(len(sets)) for b in range(a) if J.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        sizes = np.array([len(s) for s in sets])
        found = J.Trie(sets, sizes, labels).join()
        assert joined(found) == joined(every)
        assert all((a, b) in every or (b, a) in every for a, b in found)
        # First tenths alone may connect more, and never less.
        lone = np.arange(len(sets))
        firsts = [s[: J.prefix_size(len(s))] for s in sets]
        token, many = np.unique(np.concatenate(firsts), return_counts=True)
        at = [np.flatnonzero(np.isin(f, token[many > 1]) | (np.arange(len(f)) == len(f) - 1)) for f in firsts]
        some = [f[i] for f, i in zip(firsts, at)]
        for links in (J.Trie(firsts, sizes, lone).join(), J.Trie(some, sizes, lone, [i + 1 for i in at]).join()):
            root = lone.copy()
            for a, b in links:
                root[root == root[a]] = root[b]
            assert all(root[a] == root[b] for a, b in every)
        rows = [(set(x.tolist()), x.tolist(), (i + 1).tolist(), int(n)) for x, i, n in zip(some, at, sizes)]
        assert all(J.may_link(rows[a], rows[b]) for a, b in every)


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 200):
        for m in range(n, 200):
            both = -(-9 * (n + m) // 19)
            if both <= n:  # with so much in common they cannot miss each other
                assert n - both < J.prefix_size(n) and m - both < J.prefix_size(m)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 700}" for k in range(400_000))
    docs = spark.createDataFrame([(2, long), (1, long + " end"), (3, "end")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in J.with_components(docs).collect()) == [(1, 701, 1), (2, 700, 1), (3, 1, 3)]
    assert J.with_components(docs.limit(0)).collect() == []


def test_all_texts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(J, "SLICE_BYTES", 200)
    texts = [f"a{k} b{k} c{k}" + " x y z" * (k % 16 == 0) for k in range(64)]
    docs = spark.createDataFrame([(t,) for t in texts * 2 + [None, "once only here"]], "text string").repartition(3)
    filters = J._frequent(docs, 3)
    held = lambda t: [J.in_filter(f, J.ngram_sets([t.encode()])[0]).all() for f in filters]
    assert all(held(t)[0] for t in texts)  # each stands twice
    assert held("x y z") == [True, True, False, False] and held("once only here") == [False] * 4
    rare = [sum(map(int.bit_count, f.tolist())) for f in filters]
    assert rare[1:] == [1, 0, 0] and J.FILTER_BITS == 64 * len(filters[0])
