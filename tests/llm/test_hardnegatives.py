"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import hardnegatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=50):
    live = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out, seen = [], []
    for i, v, label in live:
        if i is None or i % every or (i, v, label) in seen:
            continue
        seen.append((i, v, label))
        others = [(score(v, w), j, m) for j, w, m in live if j != i]
        for p, j, _ in sorted((x for x in others if x[2] == label), key=order)[:5]:
            good = sorted((x for x in others if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(i, j, k, n[1], p, n[0]) for k, n in enumerate(good, 1)]
    return sorted(out, key=repr)


def made_rows(seed, n=700, dims=6):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        v = [x * rng.choice([0.3, 1, 1]) + rng.gauss(0, 0.3) for x in m]
        rows.append((i, v if i % 11 else [round(4 * x) / 4 for x in m], rng.randint(0, 3) if rng.random() < 0.6 else 9))
    rows += [(100, None, 1), (150, [1.0, None, 1.0], 1), (200, [float("nan")] * dims, 1), (201, [float("inf")] * dims, 1), (202, [0.0] * dims, 2), (203, [], 2), (350, [0.5], None)]
    rows += [(None, middles[0], 1), (None, middles[0], 9), (1050, [0.0] * dims, 2), (1100, middles[1][:3], 9), (-50, middles[2], 1)]
    return rows + rows[5:9] + rows[50:51] + [(50, middles[3], 2)]  # repeated rows, and an id with two vectors


@pytest.mark.parametrize("seed, block, slice_rows", [(1, H.BLOCK_BYTES, H.SLICE_ROWS), (2, 4000, 128)])
def test_equals_all_pairs(spark, monkeypatch, seed, block, slice_rows):
    monkeypatch.setattr(H, "BLOCK_BYTES", block)  # a small one makes several blocks
    monkeypatch.setattr(H, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(H, "WINDOW_ROWS", 8)
    monkeypatch.setattr(H, "SAMPLE", 40)
    rows = made_rows(seed)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", `a.b` string, Score int").repartition(3)
    got = H.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_windows_are_passed_over_and_bounds_hold():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 16))
    rows = np.floor(256 * (np.repeat(middles, 200, axis=0) + rng.normal(scale=0.1, size=(1200, 16))))
    directions = H.fit_directions(rows[::7])
    angle = H.angles(rows, directions)
    order = np.lexsort((angle.min(axis=1), angle.argmin(axis=1)))
    x = H.Rows(pa.array(order), pa.array(np.zeros(1200, int)), rows[order], angle[order].astype(np.float32))
    who = rows[::50]
    bottom, top = H.score_bounds(H.angles(who, directions), np.linalg.norm(who, axis=1), x)
    exact = H.scores(who, x.rows)
    for w, (a, b) in enumerate(zip(x.starts, x.ends)):
        assert (bottom[:, w] <= exact[:, a:b].min(axis=1)).all() and (top[:, w] >= exact[:, a:b].max(axis=1)).all()
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (top < tenth[:, None]).mean() > 0.6  # most windows get no score


def test_large_components_are_exact_or_refused():
    big = np.array([[2.0**29, -(2.0**29), 1.0], [2.0**29, 2.0**29, 3.0]])
    assert H.scores(big, big).tolist() == [[2**59 + 1, 3], [3, 2**59 + 9]]
    with pytest.raises(ValueError):
        H.scores(big * 2**20, big * 2**20)


def test_empty_tables_and_tables_without_anchors(spark):
    frame = spark.createDataFrame([(1, [0.5], 1), (2, [0.25], 2)], SCHEMA)
    assert H.hard_negatives(frame).collect() == []
    assert H.hard_negatives(frame.limit(0)).collect() == []
    lone = spark.createDataFrame([(50, [0.5], 1)], SCHEMA)
    assert H.hard_negatives(lone).collect() == []
