import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import simhash

SCHEMA = "doc_id bigint, text string, fingerprint string, source string"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    points = sorted({p for _, p in prints})
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(points):
        for b in points[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted((i, f"{p:016x}", least.get(root(p))) for i, p in prints if i is not None), {p for _, p in prints}


def texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Bravo", "ça", "delta", "été", "fox", "GOLF", "hôtel", "India", "jul", "日本", "kilo"]
    made = []
    for _ in range(n):
        made.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 9, 60]))))
        if rng.random() < 0.4:
            made.append(made[-1].upper() if rng.random() < 0.3 else made[-1] + "\t" + rng.choice(words))
    return made


def test_fingerprint_equals_the_definition():
    for text in [*texts(60, 1), "", " \n ", "A", "a  b", "A\x0bb\x85c d"]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts(120, 2))) + [(900, None), (901, ""), (7, "again alpha"), (7, "again alpha"), (None, "alpha fox kilo")]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.with_components(docs).collect() if r.doc_id is not None)
    want, _ = plain_components(rows)
    assert got == want


def test_close_points_through_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 40)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 500)] ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near]))
    want = {(int(a), int(b)) for k, a in enumerate(points) for b in points[k + 1 :] if int(a ^ b).bit_count() <= 2}
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point bigint")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_oversized_shards_are_split_again(spark, monkeypatch):
    for name, value in {"SHARD_POINTS": 40, "SAMPLE": 32, "LARGEST_SAMPLE": 64, "LEAF_SAMPLE": 16, "OVERSIZED": 2, "SPLIT_SAMPLE": 200, "ROUTED": 300}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    near = base[rng.integers(0, 1200, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near]))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point bigint")
    sizes = simhash.shards(frame, len(points)).groupBy("shard").agg(F.count_if("home").alias("own")).collect()
    assert sum(r.own for r in sizes) == len(points) and max(r.own for r in sizes) <= 80
    want = {(int(a), int(b)) for k, a in enumerate(points) for b in points[k + 1 :][np.bitwise_count(points[k + 1 :] ^ a) <= 2]}
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_million_random_points_stay_in_small_shards(spark):
    points = spark.range(1 << 20).select(F.xxhash64("id").alias("point"))
    sizes = simhash.shards(points, 1 << 20).groupBy("shard").agg(F.count_if("home").alias("own"), F.count("*").alias("rows"))
    r = sizes.agg(F.sum("own"), F.max("own"), F.max("rows"), F.sum("rows")).first()
    assert r[0] == 1 << 20 and r[1] <= simhash.OVERSIZED * simhash.SHARD_POINTS and r[2] <= 100_000
    print("rows a point", r[3] / r[0], "largest", r[1], r[2])


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a bigint, b bigint")
    got = {r.node: r.label for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_keep_one_of_each_group_and_empty_table(spark):
    rows = [(3, "one two three four"), (1, "ONE two three four"), (1, "one two three four"), (2, "quite another text of other words"), (2, "quite another text of other words"), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x", "s") for i, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 8]
    clashing = docs.withColumns({"__id": F.lit(1), "__hash": F.lit("x"), "component_id": F.lit(2), "Rows": F.lit(3), "a`b": F.lit(4)})
    assert sorted(r.doc_id for r in simhash.keep_one(clashing).collect()) == [1, 2, 8] and simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.with_components(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []
