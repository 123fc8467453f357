"""Phrase collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import collocations as C


def plain(rows, least, top, covered=80):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, g, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def made_rows(seed):
    rng, words = random.Random(seed), ["Alpha", "beta", "ça", "日本", "x y", "of", "the", "rare%d"]
    phrases = ["Prime minister of", "the united nations", "ça va bien merci", "beta beta"]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choice(words).replace("%d", str(rng.randint(0, 99))))
            parts.append(rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "!"]) if rng.random() < 0.3 else " ")
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return rows + rows[:10] + [("en", None), ("de", ""), ("de", "..."), ("en", "the " * 20_000)]


@pytest.mark.parametrize("seed, budget, top", [(1, C.GROUP_SUFFIXES, 2000), (2, 60, 25)])
def test_equals_brute_force(spark, monkeypatch, seed, budget, top):
    monkeypatch.setattr(C, "GROUP_SUFFIXES", budget)  # a small one extends prefixes by their second word
    monkeypatch.setattr(C, "SLICE_BYTES", 3000)
    rows = made_rows(seed)
    docs = spark.createDataFrame([(t, lang, "k", 1, 2.0) for lang, t in rows], "text string, lang string, `a.b` string, rank int, Phrase double").repartition(5)
    got = C.collocations(docs, least=12, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 12, top)


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 64)
    rows = made_rows(3)
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(docs, least=12).collect()) == plain(rows, 12, 2000)


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert C.collocations(docs).collect() == []
    assert C.collocations(docs.limit(0)).collect() == []


def test_groups_keep_to_the_budget():
    weights = np.array([5, 3, 9, 0, 40, 2, 2])
    first, parts = C.grouped(weights, 10)
    assert parts.tolist() == [1, 1, 1, 1, 4, 1, 1]
    held = {}
    for g, p, w in zip(first.tolist(), parts.tolist(), weights.tolist()):
        for k in range(p):
            held[g + k] = held.get(g + k, 0) + w / p
    assert max(held.values()) <= 10


def test_subtree_counts_are_leaf_totals():
    rows = np.array([[1, 2, 0, 0], [1, 2, 3, 0], [1, 2, 3, 4], [1, 5, 0, 0], [1, 2, 3, 4]], np.uint64)
    found = C.subtree(rows, np.array([1, 2, 3, 4, 5]), 4)
    assert [(p.tolist(), n.tolist()) for p, n in found] == [([[1, 2], [1, 5]], [11, 4]), ([[1, 2, 3]], [10]), ([[1, 2, 3, 4]], [8])]
