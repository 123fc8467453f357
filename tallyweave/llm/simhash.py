"""SimHash near-duplicates, linked through vantage-point trees.

Every document gets a 64-bit fingerprint. Equal fingerprints are one point. A tree
of vantage points, fitted on a bounded sample of fingerprints, deals all points out
to shards: a point goes to the shard on its side of each vantage radius and, where
the triangle bound lets a neighbour lie beyond the radius, to the other shard as a
visitor. Each shard grows its own vantage-point tree and compares what is left of
the candidates exactly. A shard emits a spanning forest of the links it found, so a
dense group costs one row a point and not one a pair, and components of different
shards are joined by label propagation with pointer jumping. A shard that has too many
points of its own is dealt out again by a tree of its own, fitted where the shard is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import add_columns, as_bytes, column, hash_fraction, materialize, spaced_words

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints that the top tree is fitted on: about LEAF_SAMPLE for each shard, these
#: at least and at most.
LEAF_SAMPLE, SAMPLE, LARGEST_SAMPLE = 32, 32_768, 1 << 20
#: Points of its own that a shard should have; with more than so many times that, it is
#: split again, by a tree fitted on about SPLIT_SAMPLE of them. Rows routed at once then.
SHARD_POINTS, OVERSIZED, SPLIT_SAMPLE, ROUTED = 4096, 8, 4096, 200_000
#: Points that a shard's tree compares without a further split.
LEAF_POINTS = 64
#: A split must save at least a tenth of the comparisons, or the node stays a leaf.
WORTHWHILE = 0.9
#: Pairs that a shard holds before they are folded into its forest.
PAIRS_HELD = 500_000
#: Cells of one comparison table.
CELLS = 2_000_000


def shingles(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of a text's word shingles in their order, repeats included; a text of
    fewer words is one shingle, an empty one none."""
    words = spaced_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, mix = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([mix(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    view, ends = memoryview(joined), ends[width - 1 :].tolist()
    return np.array([mix(view[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned SimHash of these hashes: a bit is 1 if set in over half of them."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of a text's word shingles, repeats included."""
    return fingerprint_of(shingles(text, width))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = SHINGLE_WORDS) -> DataFrame:
    """docs with a bigint column of each text's fingerprint; a null text counts as
    empty and has fingerprint 0."""

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (texts,) in batches:
            made = np.array([fingerprint(t, width) for t in as_bytes(texts)], np.uint64)
            yield [pa.array(made.view(np.int64))]

    return add_columns(docs, [T.StructField(name, T.LongType())], [text], run)


def _split(points: np.ndarray, radius: int, tries: int) -> tuple[int, int] | None:
    """The vantage point and the inner radius that leave the fewest comparisons,
    or None when no split is worth its copies."""
    n, best, found = len(points), WORTHWHILE, None
    for at in np.linspace(0, n - 1, tries).astype(np.int64):
        seen = np.cumsum(np.bincount(np.bitwise_count(points ^ points[at]), minlength=65))
        inner = np.arange(64)
        nin = seen[inner]
        visit_in = seen[np.minimum(64, inner + radius)]
        visit_out = n - np.where(inner >= radius, seen[np.maximum(0, inner - radius)], 0)
        cost = (nin * visit_in + (n - nin) * visit_out) / n / n
        cost[(nin == 0) | (nin == n)] = 1
        k = int(np.argmin(cost))
        if cost[k] < best:
            best, found = cost[k], (int(points[at]), k)
    return found


def fit_tree(sample: np.ndarray, leaf: int, radius: int = RADIUS) -> list[tuple]:
    """Nodes (vantage point, inner radius, inner node, outer node), or () for a
    leaf, whose place in the list is its shard."""
    nodes: list[tuple] = [()]
    todo = [(0, sample)]
    while todo:
        at, points = todo.pop()
        cut = _split(points, radius, 16) if len(points) > leaf else None
        if cut:
            near = np.bitwise_count(points ^ np.uint64(cut[0])) <= cut[1]
            nodes[at] = (*cut, len(nodes), len(nodes) + 1)
            nodes += [(), ()]
            todo += [(len(nodes) - 2, points[near]), (len(nodes) - 1, points[~near])]
    return nodes


def _divide(home: np.ndarray, visit: np.ndarray, vantage: int, inner: int, radius: int) -> tuple:
    """Home points and visitors of both sides. A pair that the radius parts is
    found on the inner side, where its outer point is a visitor; a visitor goes
    wherever the triangle bound allows a neighbour."""
    near, far = np.bitwise_count(home ^ np.uint64(vantage)), np.bitwise_count(visit ^ np.uint64(vantage))
    inside = near <= inner
    crossing = home[~inside & (near <= inner + radius)]
    return (home[inside], np.concatenate([visit[far <= inner + radius], crossing])), (home[~inside], visit[far > inner - radius])


def route(nodes: list[tuple], points: np.ndarray, radius: int = RADIUS, visitors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, home points, visitors) for every shard that these points reach."""
    todo = [(0, points, points[:0] if visitors is None else visitors)]
    while todo:
        at, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if not nodes[at]:
            yield at, home, visit
            continue
        vantage, inner, a, b = nodes[at]
        for child, part in zip((a, b), _divide(home, visit, vantage, inner, radius)):
            todo.append((child, *part))


def close_pairs(home: np.ndarray, visit: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius among distinct home points, and between home
    points and visitors, through a vantage-point tree of this shard."""
    todo = [(home, visit)]
    while todo:
        home, visit = todo.pop()
        if not len(home) or len(home) + len(visit) < 2:
            continue
        cut = _split(home, radius, 4) if len(home) > LEAF_POINTS else None
        if cut:
            todo += _divide(home, visit, *cut, radius)
            continue
        both = np.concatenate([home, visit])
        for at in range(0, len(home), step := max(1, CELLS // len(both))):
            rows = home[at : at + step]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ both[None, :]) <= radius)
            new = j > i + at  # a pair of home points once, without the point itself
            if new.any():
                yield rows[i[new]], both[j[new]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of these links: its members and, beside each, the
    component's smallest point."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _dealt(nodes: list[tuple], home: np.ndarray, visit: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, points, whether at home) of every shard that these points reach."""
    for shard, own, guests in route(nodes, home, radius, visit):
        both = np.concatenate([own, guests]).view(np.int64)
        yield shard, both, np.arange(len(both)) < len(own)


def _to_shards(points: DataFrame, nodes: list[tuple], radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64)
            for shard, both, at_home in _dealt(nodes, at, at[:0], radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), shard, np.int64)), pa.array(both), pa.array(at_home)], names=["shard", "point", "home"])

    return points.mapInArrow(run, "shard bigint, point bigint, home boolean")


def _tree_of(points: DataFrame, n: int, radius: int) -> list[tuple]:
    """The top tree; n is the number of points."""
    wanted = min(LARGEST_SAMPLE, max(SAMPLE, LEAF_SAMPLE * n // SHARD_POINTS))
    drawn = points.where(hash_fraction(F.col("point")) < min(1.0, wanted / max(n, 1))).toArrow()
    sample = np.sort(drawn.column("point").to_numpy().view(np.uint64))
    return fit_tree(sample, max(LEAF_SAMPLE, SHARD_POINTS * len(sample) // max(n, 1)), radius)


def _split_again(dealt: DataFrame, large: DataFrame, radius: int) -> DataFrame:
    """The rows of oversized shards, dealt out by a tree of each shard's own; `large`
    has their numbers of points and rows. `whole` marks shards that their tree does
    not part."""

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        points, own = np.sort(table.column("point").to_numpy().view(np.uint64)), table.column("own")[0].as_py()
        nodes = fit_tree(points, max(LEAF_SAMPLE, SHARD_POINTS * len(points) // own), radius)
        tree = [[int(np.uint64(x[0]).view(np.int64)), *x[1:]] if x else [] for x in nodes]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([tree], pa.list_(pa.list_(pa.int64())))})

    def deal(points: pa.Table, trees: pa.Table) -> pa.Table:
        if not points.num_rows:
            return pa.schema([("shard", pa.int64()), ("point", pa.int64()), ("home", pa.bool_()), ("whole", pa.bool_())]).empty_table()
        shard, tree = points.column("shard")[0].as_py(), trees.column("tree")[0].as_py() if trees.num_rows else [[]]
        nodes = [(x[0] % (1 << 64), *x[1:]) if x else () for x in tree]
        at, home = points.column("point").to_numpy().view(np.uint64), points.column("home").to_numpy()
        out = []
        for leaf, both, at_home in _dealt(nodes, at[home], at[~home], radius):
            name = np.full(len(both), xxhash.xxh64_intdigest(f"{shard} {leaf}".encode(), SEED) >> 1, np.int64)
            out.append(pa.table({"shard": name, "point": both, "home": at_home, "whole": np.full(len(both), len(nodes) == 1)}))
        return pa.concat_tables(out)

    rows = dealt.join(large, "shard")
    sample = rows.where(F.col("home") & (hash_fraction(F.col("point"), F.col("shard")) < SPLIT_SAMPLE / F.col("own")))
    trees = sample.groupBy("shard").applyInArrow(fit, "shard bigint, tree array<array<bigint>>")
    parts = F.ceil(F.col("rows") / ROUTED).cast("int")
    left = rows.select("shard", F.pmod(F.xxhash64("point"), parts).cast("int").alias("part"), "point", "home")
    right = trees.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "tree")
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(deal, "shard bigint, point bigint, home boolean, whole boolean")


def shards(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(shard, point, home): all n points dealt out, each at home in one shard and a
    visitor in those whose points it may be close to. A shard has OVERSIZED *
    SHARD_POINTS points of its own at most, unless no tree can part them."""
    dealt = materialize(_to_shards(points, _tree_of(points, n, radius), radius).withColumn("whole", F.lit(False)))
    done: list[DataFrame] = []
    while True:
        sizes = dealt.where("not whole").groupBy("shard").agg(F.count_if("home").alias("own"), F.count("*").alias("rows"))
        large = materialize(sizes.where(F.col("own") > OVERSIZED * SHARD_POINTS))
        if large.isEmpty():
            return reduce(DataFrame.union, [*done, dealt]).select("shard", "point", "home")
        done.append(dealt.join(large, "shard", "left_anti").select("shard", "point", "home", "whole"))
        dealt = materialize(_split_again(dealt.drop("whole"), large, radius))


def near_pairs(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every pair (a, b, distance) of distinct bigint fingerprints in column
    `point` within the radius, once, a < b as unsigned numbers."""
    points = materialize(points.where(F.col("point").isNotNull()).select("point").distinct())

    def run(table: pa.Table) -> pa.Table:
        at, home = table.column("point").to_numpy().view(np.uint64), table.column("home").to_numpy()
        found = list(close_pairs(at[home], at[~home], radius))
        a, b = (np.concatenate([x[k] for x in found]) if found else at[:0] for k in (0, 1))
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": low.view(np.int64), "b": high.view(np.int64), "distance": np.bitwise_count(low ^ high).astype(np.int32)})

    return shards(points, points.count(), radius).groupBy("shard").applyInArrow(run, "a bigint, b bigint, distance int")


def least_neighbours(points: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b as unsigned numbers: pairs within the radius among the n distinct
    bigint fingerprints in column `point`. A shard gives each of its points the smallest
    one that is close to it, if that is smaller, so a dense group costs one row a point
    and shard; the smallest of all close ones is always among them."""

    def run(table: pa.Table) -> pa.Table:
        at, home = table.column("point").to_numpy().view(np.uint64), table.column("home").to_numpy()
        names = np.sort(at)
        least = names.copy()
        for a, b in close_pairs(at[home], at[~home], radius):
            np.minimum.at(least, np.searchsorted(names, np.maximum(a, b)), np.minimum(a, b))
        own = least < names
        return pa.table({"a": least[own].view(np.int64), "b": names[own].view(np.int64)})

    return shards(points, n, radius).groupBy("shard").applyInArrow(run, "a bigint, b bigint").distinct()


def _forest_links(points: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b) links that connect what pairs within the radius connect."""

    def run(table: pa.Table) -> pa.Table:
        at, home = table.column("point").to_numpy().view(np.uint64), table.column("home").to_numpy()
        a, b = at[:0], at[:0]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in close_pairs(at[home], at[~home], radius):
            held.append(pair)
            if sum(len(x) for x, _ in held) > PAIRS_HELD:
                a, b = forest(*(np.concatenate([y, *(x[k] for x in held)]) for k, y in enumerate((a, b))))
                held = []
        if held:
            a, b = forest(*(np.concatenate([y, *(x[k] for x in held)]) for k, y in enumerate((a, b))))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return shards(points, n, radius).groupBy("shard").applyInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the component's smallest
    node. Each round takes the least label of all neighbours and then jumps to the
    label's label, so the rounds grow with the logarithm of a chain's length."""
    links = materialize(links.where("a is not null and b is not null and a <> b"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")))
    while True:
        told = both.join(labels, "node").groupBy(F.col("to").alias("node")).agg(F.min("label").alias("told"))
        hooked = labels.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = materialize(hooked.join(jump, "low").select("node", "was", F.least("low", "far").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def with_components(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, fingerprint, component_id, keeper_hash) for every row of docs.

    component_id is the smallest id reachable over links within the radius, the
    row's own included. Null ids take no part in the smallest id; a component with
    null ids only has component_id null. Repeated rows give repeated results, ties
    on the id are equal, and an empty table gives no rows. keeper_hash is the
    smallest text_hash among the component's rows that have that id, so that
    (component_id, keeper_hash) names one text of each component."""
    prints = materialize(
        with_fingerprint(docs.select(F.col(id_col), "text", F.xxhash64("text").alias("text_hash"))).select(id_col, "text_hash", F.col("fingerprint").alias("point"))
    )
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    points = materialize(prints.groupBy("point").agg(first.alias("first")))
    n = points.count()
    labels = components(_forest_links(points.select("point"), n, radius)).withColumnRenamed("node", "point")
    linked = labels.join(points, "point")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    joined = labels.join(least, "label").select("point", "least")
    # Cut here, so that the last join has both its shuffles to itself and can split a hot point.
    named = materialize(points.join(joined, "point", "left").select("point", F.coalesce("least", "first").alias("least")))
    return prints.join(named, "point").select(
        id_col, "text_hash", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"), F.col("least.hash").alias("keeper_hash")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each near-duplicate component, that of the smallest id.
    Of rows repeated with the same id and text one stays; a component whose ids are
    all null keeps one row as well."""
    return keepers(docs, with_components(docs, id_col, radius), id_col)


def keepers(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that component_id and keeper_hash of `found` name, one for each
    pair. Texts are shuffled once, but where rows repeat both id and text."""
    same = column(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash"))
    named = materialize(found.where(same).groupBy("component_id", "keeper_hash").agg(F.count("*").alias("rows")))
    names = [f"__c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    own, text = (names[[c.lower() for c in docs.columns].index(c.lower())] for c in (id_col, "text"))
    joined = renamed.join(named, F.col(own).eqNullSafe(F.col("component_id")) & (F.xxhash64(text) == F.col("keeper_hash")))
    if not named.where("rows > 1").isEmpty():
        joined = joined.dropDuplicates(["component_id", "keeper_hash"])
    return joined.select(*names).toDF(*docs.columns)
