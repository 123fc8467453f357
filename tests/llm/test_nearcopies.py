"""The near_duplicates stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from tallyweave.llm import nearcopies, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted(least.values())


def made_rows(seed):
    """Originals, copies with zero to eight changed words, copies of copies, a common opening."""
    rng, texts = random.Random(seed), ["", " \n", "one two", "ONE  two", "one two three four five"]
    word = lambda: f"w{rng.randint(0, 4000)}"
    opening = [word() for _ in range(40)]
    for k in range(40):
        texts.append(" ".join((opening if k % 4 == 0 else []) + [word() for _ in range(rng.choice([12, 60, 150, 400]))]))
        for _ in range(rng.choice([0, 1, 3, 12])):
            words = rng.choice(texts[-3:]).split()
            for _ in range(rng.randint(0, 8) if words else 0):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 0), (3, 2)])
def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    monkeypatch.setattr(nearcopies, "SAMPLED", 0.5)
    rows = made_rows(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)
    assert len(plain_kept(rows)) < len({t.lower() for _, t in rows}) - 15


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(3, "one two three four"), (1, "ONE two three four"), (1, "one two three four"), (2, "another text"), (2, "another text"), (9, None), (8, ""), (None, "lone words")]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id or 0 for r in nearcopies.keep_one(docs).collect()) == [0, 1, 2, 8]
    assert nearcopies.keep_one(docs.limit(0)).collect() == []


def test_fingerprints_propose_pairs_to_the_stage(spark, monkeypatch):
    """The tree proposes each fingerprint's smallest close one, and the stage asks it."""
    told = []
    monkeypatch.setattr(nearcopies, "proposed", lambda points, ask=nearcopies.proposed: told.append(points) or ask(points))
    texts = {t for _, t in made_rows(4)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(sorted(texts))], SCHEMA)
    corpus_pipeline.near_duplicates(spark, docs, "").count()
    points = {r.point: r.print % (1 << 64) for r in told[0].select("point", "print").collect()}
    pairs = {(r.a, r.b) for r in nearcopies.proposed(told[0]).collect()}
    heads = {p: min(k for k, v in points.items() if v == p) for p in points.values()}
    apart = lambda a, b: (points[a] ^ points[b]).bit_count()
    assert pairs and all(a < b and apart(a, b) <= nearcopies.RADIUS for a, b in pairs)
    for k, own in points.items():
        close = [v for v in heads if v < own and (v ^ own).bit_count() <= nearcopies.RADIUS]
        wanted = {heads[own]} if heads[own] != k else {heads[min(close)]} if close else set()
        assert all((min(k, w), max(k, w)) in pairs for w in wanted)
    assert any(apart(a, b) for a, b in pairs)


def test_neighbours_are_the_least_within_the_radius(spark, monkeypatch):
    """Many fingerprints in balls, split into shards by the tree."""
    monkeypatch.setattr(simhash, "SHARD_POINTS", 200)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(40)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.least_neighbours(spark.createDataFrame(signed, "point bigint"), len(prints), 3)
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found.collect()}
    assert all(a < b and (a ^ b).bit_count() <= 3 for a, b in got)
    for p in prints:
        close = [q for q in prints if q < p and (p ^ q).bit_count() <= 3]
        assert not close or (min(close), p) in got
