import random
import re

import pytest

from tallyweave.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    out = {}
    for i, text in docs:
        w, hit, named, longest = words(text), set(), set(), {}
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for a in range(len(w) - n + 1 if n else 0):
                for b in range(len(v) - n + 1):
                    if w[a : a + n] == v[b : b + n]:
                        hit.update(range(a, a + n))
                        named.add(item)
                        k = n
                        while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                            k += 1
                        longest[item] = max(k, longest.get(item, 0))
        out[i] = (len(w), len(hit), sorted(str(x) for x in named if x is not None), {str(k): v for k, v in longest.items() if k is not None})
    return out


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ça", "été", "日本", "42", "x", "the", "of", "run"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 10, 13, 40]))) for k in range(8)] + [(20, None), (21, "..."), (None, text(12)), (3, text(15))]
    docs = []
    for k in range(60):
        t = text(rng.choice([0, 5, 30, 200]))
        if rng.random() < 0.5 and (item := rng.choice(items)[1]):
            t += " " + item.upper() + " " + text(3)
        docs.append((k, t))
    return docs + [(100, None), (101, ""), (102, "the " * 300)], items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)  # a small one makes several passes
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    docs, items = data(3)
    frame = spark.createDataFrame([(i, t, "keep", 7) for i, t in docs], "doc_id bigint, text string, extra string, n_words int")
    found = D.find_contamination(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert found.columns[:3] == ["doc_id", "text", "extra"]
    got = {}
    for r in found.withColumn("n_hit", D.n_hit()).collect():
        longest = {}
        for m in r.matches:
            if m.item_id is not None:
                longest[m.item_id] = max(m.n_words, longest.get(m.item_id, 0))
        got[r.doc_id] = (r.n_words, r.n_hit, r.item_ids, longest)
    assert got == plain(docs, items)


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "clean"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "B c d e f g h i j k")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in D.remove_contaminated(docs, bench).collect()) == [2, 3]
    assert D.remove_contaminated(docs, bench.limit(0)).count() == 3
    assert D.remove_contaminated(docs.limit(0), bench).count() == 0
