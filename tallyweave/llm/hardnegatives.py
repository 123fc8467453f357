"""Hard negatives of embeddings by angular triangle filtering.

Every row stores its angles to some reference directions. For a query and a row the
angles to one direction r give an interval of the angle between them,
|t(q, r) - t(x, r)| <= t(q, x) <= min(t(q, r) + t(x, r), 2 pi - t(q, r) - t(x, r)), and
with the norms bounds of their inner product. Rows lie in windows of neighbours by
nearest direction and angle; a window whose bounds, widened for rounding, do not overlap
the scores that an anchor still looks for is passed over, and only the others get integer
scores. Anchors come in blocks of bounded size, all rows pass each block where they lie,
and each task keeps an anchor's few best, so that no pairs are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Batches, add_columns, column, hash_fraction, rewritten

POSITIVES, NEGATIVES = 5, 3
#: Reference directions, fitted on about so many rows; the same rows give each anchor its
#: first bounds. Both change the work, not the result.
DIRECTIONS, SAMPLE = 32, 2048
#: Rows of a window, rows that are dealt with at once, and anchors that are.
WINDOW_ROWS, SLICE_ROWS, ANCHORS_AT_ONCE = 64, 8192, 1024
#: Bytes of anchors in a block. More anchors are searched block after block.
BLOCK_BYTES = 64_000_000
#: Radians by which stored angles are widened; they are kept as float32.
SLACK = 1e-5
_NONE = np.iinfo(np.int64).min


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """floor(256 * x) of all components, a row each; shorter rows end in zeros."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def angles(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction of length 1; 0 for a row of zeros."""
    width = max(rows.shape[1], directions.shape[1])
    size = np.linalg.norm(rows, axis=1)
    cos = (_padded(rows, width) / np.where(size > 0, size, 1)[:, None]) @ _padded(directions, width).T
    return np.where(size[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0)


def fit_directions(sample: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors that lie among the sample's rows: each starts at the row farthest
    from those before it and then moves to the middle of the rows that are nearest to it."""
    size = np.linalg.norm(sample, axis=1)
    rows = sample[size > 0] / size[size > 0, None]
    if not len(rows):
        return np.eye(1, max(1, sample.shape[1]))
    nearest, picked = rows @ rows[0], [0]
    while len(picked) < n and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[picked[-1]])
    out = rows[picked]
    for _ in range(5):
        middle = np.zeros_like(out)
        np.add.at(middle, (rows @ out.T).argmax(axis=1), rows)
        size = np.linalg.norm(middle, axis=1)
        out = np.where(size[:, None] > 1e-9, middle / np.maximum(size, 1e-9)[:, None], out)
    return out


class Rows:
    """Rows with their ids, labels and angles, in windows of neighbours."""

    def __init__(self, ids: pa.Array, labels: pa.Array, rows: np.ndarray, angle: np.ndarray) -> None:
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.labels = labels.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows, self.norms = rows, np.linalg.norm(rows, axis=1)
        at = np.arange(0, len(rows), WINDOW_ROWS)
        self.starts, self.ends = at, np.append(at[1:], len(rows))[: len(at)]
        if not len(at):
            angle, self.norms, at = np.zeros((1, angle.shape[1])), np.zeros(1), np.zeros(1, int)
        self.near, self.far = (f.reduceat(angle, at, axis=0).astype(np.float64) for f in (np.minimum, np.maximum))
        self.short, self.long = (f.reduceat(self.norms, at) for f in (np.minimum, np.maximum))


def score_bounds(angle: np.ndarray, norms: np.ndarray, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor in each window."""
    low = np.zeros((len(angle), len(x.starts)))
    high = np.full(low.shape, math.pi)
    for k in range(angle.shape[1]):
        own, near, far = angle[:, k, None], x.near[:, k], x.far[:, k]
        np.maximum(low, np.maximum(near - own, own - far), out=low)
        np.minimum(high, np.minimum(own + far, 2 * math.pi - own - near), out=high)
    most, least = np.cos(np.maximum(low - 2 * SLACK, 0)), np.cos(np.minimum(high + 2 * SLACK, math.pi))
    size = norms[:, None]
    top = size * np.where(most > 0, x.long, x.short) * most
    bottom = size * np.where(least > 0, x.short, x.long) * least
    room = 1 + 1e-9 * size * x.long
    return bottom - room, top + room


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = _padded(a, width), _padded(b, width)
    most = max(np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0), 0.0)
    if most < 2.0**52:  # bounds all sums of |a| * |b| on the way
        return a @ b.T
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("an inner product of these embeddings does not fit a bigint")


class Anchors:
    """A block of anchors; low and high are the scores that each looks for, a column a
    list. A list keeps its best `most` rows and raises its low as it fills."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int) -> None:
        self.ids, self.labels, self.rows, self.angle, self.low, self.high, self.same, self.most = ids, labels, rows, angle, low, high, same, most

    def hits(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, row) of rows that an anchor looks for."""
        found: list[tuple] = []
        norms, lists = np.linalg.norm(self.rows, axis=1), self.low.shape[1]
        for at in range(0, len(self.ids), ANCHORS_AT_ONCE):
            part = slice(at, at + ANCHORS_AT_ONCE)
            bottom, top = score_bounds(self.angle[part], norms[part], x)
            low, high = self.low[part], self.high[part]
            wanted = np.zeros(bottom.shape, bool)
            for k in range(lists):
                wanted |= (top >= low[:, k, None]) & (bottom <= high[:, k, None]) & (low[:, k] <= high[:, k])[:, None]
            for w in np.flatnonzero(wanted.any(axis=0)).tolist():
                who, rows = np.flatnonzero(wanted[:, w]), slice(x.starts[w], x.ends[w])
                able = (self.labels[part][who, None] == x.labels[rows]) == self.same
                able &= (self.ids[part][who, None] != x.ids[rows]) | x.none[rows]
                score = scores(self.rows[part][who], x.rows[rows])
                for k in range(lists):
                    i, j = np.nonzero(able & (score >= low[who, k, None]) & (score <= high[who, k, None]))
                    found.append(((who[i] + at) * lists + k, score[i, j].astype(np.int64), j + x.starts[w]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))

    def best(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> np.ndarray:
        """Places of each list's best rows, best first; low is raised to the last of a
        full list."""
        order = np.lexsort((ids, none, -score, which))
        own = which[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        last = order[rank == self.most - 1]
        np.maximum.at(self.low.reshape(-1), which[last], score[last])
        return order[rank < self.most]

    def learn(self, x: Rows) -> None:
        """Raises low by rows that are looked at again later."""
        which, score, row = self.hits(x)
        self.best(which, score, x.ids[row], x.none[row])


def _search(stored: DataFrame, anchors: Anchors, sample: Rows) -> DataFrame:
    """(list, score, id) of the best rows of each task for each list."""
    shared = stored.sparkSession.sparkContext.broadcast((anchors, sample))

    def run(batches: Batches) -> Batches:
        told, seen = shared.value
        own = Anchors(told.ids, told.labels, told.rows, told.angle, told.low.copy(), told.high, told.same, told.most)
        own.learn(seen)
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                ids, labels, vectors, angle = batch.slice(at, SLICE_ROWS).columns
                x = Rows(ids, labels, matrix(vectors), np.asarray(angle.flatten()).reshape(len(ids), -1))
                which, score, row = own.hits(x)
                held = tuple(np.concatenate(p) for p in zip(held, (which, score, x.ids[row], x.none[row])))
                held = tuple(h[keep] for keep in [own.best(*held)] for h in held)
        which, score, ids, none = held
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(score), pa.array(ids, mask=none)], names=["list", "score", "id"])

    return stored.select("id", "label", "vector", "angle").mapInArrow(run, "list bigint, score bigint, id bigint")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each list, with their rank."""
    view = found.selectExpr("*", "row_number() over (partition by list order by score desc, id asc nulls last) as rank")
    return view.where(F.col("rank") <= most)


def with_angles(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """rows (id, label, vector) with their angles; a task's neighbours in angle to the
    nearest direction stand side by side."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                angle = angles(matrix(part.column(2)), shared.value)
                order = np.lexsort((angle.min(axis=1), angle.argmin(axis=1)))
                ends = pa.array(np.arange(len(order) + 1, dtype=np.int32) * angle.shape[1])
                made = pa.ListArray.from_arrays(ends, pa.array(angle[order].astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(order)) for c in part.columns), made], names=["id", "label", "vector", "angle"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("angle", T.ArrayType(T.FloatType()))]))


def _prepared(embeddings: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    rows = embeddings.select(column(vec_id).cast("bigint").alias("id"), column(label).cast("bigint").alias("label"), column(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    changed = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & whole).withColumn("label", changed)


def _columns(table: pa.Table) -> list[pa.Array]:
    """id, label and vector, by id."""
    return [pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], t) for c, t in (("id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64())))]


def hard_negatives(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for
    each anchor, a row whose id `every` divides, and each of its first `positives` other
    rows of its label, the first `negatives` rows of other labels whose score is between
    50 and 95 per cent of the positive's.

    Scores are integer inner products of floor(256 * x); higher ones come first, then
    smaller ids, then rows without an id. Where 7 divides an id the label moves on by one,
    mod 10. Rows with a null label or vector, or a component that is null or not finite,
    take no part. A row of an anchor's id is not another row; an anchor that is repeated
    whole is one anchor, other repeated rows stand each for itself. Missing components of
    shorter vectors count as zero, an empty vector scores 0. A positive without such rows
    gives none, an empty table gives none. Scores beyond 64 bits raise an error. Other
    columns are not read."""
    spark = embeddings.sparkSession
    rows = _prepared(embeddings, vec_id, vector, label)
    n = rows.count()
    drawn = rows.where(hash_fraction(F.col("id"), F.col("vector")) < SAMPLE / max(n, 1)).limit(2 * SAMPLE).toArrow()
    ids, labels, vectors = _columns(drawn.sort_by("id"))
    sample = matrix(vectors)
    directions = fit_directions(sample)
    seen = Rows(ids, labels, sample, angles(sample, directions))
    stored = rewritten(with_angles(rows, directions), "angles")

    anchors = stored.where(F.col("id") % every == 0).select("id", "label", "vector").distinct()
    count, widest = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil(count * 8 * ((widest or 0) + len(directions) + 16) / BLOCK_BYTES))
    made = []
    for b in range(blocks):
        ids, labels, vectors = _columns(anchors.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == b).toArrow().sort_by("id"))
        ids, labels, own = ids.to_numpy(), labels.to_numpy(), matrix(vectors)
        angle = angles(own, directions)
        wide = np.full((len(ids), 1), np.iinfo(np.int64).max)
        first = Anchors(ids, labels, own, angle, np.full((len(ids), 1), _NONE), wide, True, positives)
        found = _first(_search(stored, first, seen), positives).toArrow()
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        at = (found.column("list").to_numpy(), found.column("rank").to_numpy() - 1)
        score = found.column("score").to_numpy()
        low[at], high[at] = -(-score // 2), 95 * (score // 100) + 95 * (score % 100) // 100
        second = Anchors(ids, labels, own, angle, low, high, False, negatives)
        best = _first(_search(stored, second, seen), negatives)
        lists = pa.table({"list": at[0] * positives + at[1], "anchor_id": ids[at[0]], "positive_id": found.column("id"), "positive_score": score})
        joined = best.join(F.broadcast(spark.createDataFrame(lists, "list bigint, anchor_id bigint, positive_id bigint, positive_score bigint")), "list")
        part = joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made.append(rewritten(part, "negatives") if blocks > 1 else part)
    return reduce(DataFrame.union, made)
