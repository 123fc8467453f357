"""Near copies by SimHash and exact Jaccard similarity of word shingles, without a lossy step.

Equal shingle sets are one point, with a SimHash fingerprint. The vantage-point tree of
simhash proposes pairs of close fingerprints, and each is compared exactly. Sets of
similarity 4/5 often lie further apart than a tree can search, so what the fingerprints
leave apart is completed: shingles have one global order, rare ones first, and two sets of similarity 4/5 or more share a shingle among the first fifth of each
(prefix filter). This holds for any order, so counts of a sample may decide it: they
change the work, not the result. Sets that share such a shingle are compared exactly.
First each is compared with one pivot of each shingle, a few times, which joins dense
groups at one row a point; then all pairs that these links have not yet joined are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import add_columns, as_bytes, hash_fraction, materialize
from tallyweave.llm.simhash import components, fingerprint_of, keepers, least_neighbours, shingles

SHINGLE_WORDS = 5
#: Bits within which fingerprints propose a pair. Each further bit costs more visitors in
#: the tree's shards (README); it changes the work, not the result.
RADIUS = 3
#: Share of the documents whose shingles are counted, and how many of the counted ones
#: that stand there OFTEN times or more are put last, the most frequent of them.
SAMPLED, OFTEN, MOST_FREQUENT = 1 / 16, 3, 200_000
#: Rounds of comparisons with pivots before all pairs that are left; each costs the
#: driver plans, and a second one joined little more in dense groups.
ROUNDS = 1


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingles(text, width))


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: as many as one needs to share
    one with every set of similarity 4/5 or more. `frequent` is ascending."""
    seen = np.zeros(len(own), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        seen = np.where(frequent[at] == own, counts[at], 0)
    return own[np.lexsort((own, seen))[: len(own) - (4 * len(own) + 4) // 5 + 1]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (texts,) in batches:
            yield [_lists([shingle_set(t, width) for t in as_bytes(texts)])]

    return add_columns(docs, [T.StructField("own", T.ArrayType(T.LongType()))], ["text"], run)


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of the sample, ascending, with their counts."""
    drawn = _with_sets(docs.where(hash_fraction(F.col("text")) < SAMPLED).select("text"), width)
    counted = drawn.select(F.explode("own").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN)
    table = counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, counts = table.column("token").to_numpy().view(np.uint64), table.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _with_prefix(docs: DataFrame, width: int) -> DataFrame:
    """docs with point (a hash of the shingle set), print (its fingerprint), n (its size)
    and first (its prefix)."""
    told = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for (texts,) in batches:
            sets = [shingle_set(t, width) for t in as_bytes(texts)]
            points = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            prints = np.array([fingerprint_of(s) for s in sets], np.uint64)
            yield [pa.array(points.view(np.int64)), pa.array(prints.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), _lists([prefix(s, *told.value) for s in sets])]

    fields = [
        T.StructField("point", T.LongType()),
        T.StructField("print", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("first", T.ArrayType(T.LongType())),
    ]
    return add_columns(docs, fields, ["text"], run)


def proposed(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) pairs of points whose fingerprints are equal or within the radius: each
    point with the first of its fingerprint, and that with the first of a close one."""
    heads = materialize(points.groupBy("print").agg(F.min("point").alias("head")))
    same = points.join(heads, "print").where("point <> head").select(F.col("head").alias("a"), F.col("point").alias("b"))
    close = least_neighbours(heads.select(F.col("print").alias("point")), heads.count(), radius)
    a, b = (heads.select(F.col("print").alias(k), F.col("head").alias(f"head_{k}")) for k in "ab")
    near = close.join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _may_match(a: str, b: str) -> Column:
    """Whether sizes and places of a shared shingle allow similarity 4/5, were it the
    first that both have. A pair that is similar enough passes at its first one."""
    most = F.expr(f"least({a}.n - {a}.at, {b}.n - {b}.at)")
    return F.expr(f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n)") & (9 * most >= F.expr(f"4 * ({a}.n + {b}.n)"))


def _links(docs: DataFrame, points: DataFrame, id_col: str, width: int) -> DataFrame:
    """(a, b) pairs of similarity 4/5 or more that connect what all such pairs connect."""
    placed = points.select("point", "n", F.posexplode("first").alias("at", "token"))
    shared = materialize(placed.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1").drop("df"))
    lists = materialize(shared.groupBy("point", "n").agg(F.collect_list("token").alias("tokens")))
    keyed = docs.select(F.col(id_col).alias("__own"), "text", F.xxhash64("text").alias("__text"))
    rest = F.expr("greatest((4 * na + 4) div 5, (4 * nb + 4) div 5) - 1")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # What both share is in the shorter reaching prefix, and so in the other as well, or behind it.
        a, b = (lists.select(F.col("point").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}")) for k in "ab")
        told = pairs.distinct().join(a, "a").join(b, "b").where(9 * (F.size(F.array_intersect("ta", "tb")) + rest) >= F.expr("4 * (na + nb)"))
        likely = materialize(told.select("a", "b"))
        ends = likely.select(F.explode(F.array("a", "b")).alias("point")).distinct()
        wanted = points.join(ends, "point").select("point", F.col("first_row.id").alias("__id"), F.col("first_row.hash").alias("__hash"))
        rows = keyed.join(wanted, (keyed["__text"] == wanted["__hash"]) & keyed["__own"].eqNullSafe(wanted["__id"])).select("point", "text").dropDuplicates(["point"])
        sets = materialize(_with_sets(rows, width).select("point", "own"))
        a, b = (sets.select(F.col("point").alias(k), F.col("own").alias(f"of_{k}")) for k in "ab")
        both = F.size(F.array_intersect("of_a", "of_b"))
        return materialize(likely.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"))

    links, named = None, shared.withColumn("label", F.col("point"))
    for turn in range(ROUNDS + 1):
        left = named.alias("x")
        if turn < ROUNDS:
            # The set with the fewest rarer shingles before this one: in a group of copies, the original.
            pivot = F.min_by(F.struct("point", "n", "at", "label"), F.struct("at", F.xxhash64("point", F.lit(turn)), "point"))
            heads = named.groupBy("token").agg(pivot.alias("p"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            right = heads.select("token", "p.*").alias("y")
            able = F.expr("x.token = y.token and x.label <> y.label")
        else:
            right, able = named.alias("y"), F.expr("x.token = y.token and x.label <> y.label and x.point < y.point")
        pairs = left.join(right, able & _may_match("x", "y")).select(F.least("x.point", "y.point").alias("a"), F.greatest("x.point", "y.point").alias("b"))
        found = confirmed(pairs if turn else proposed(points).union(pairs))
        links = found if links is None else links.union(found)
        if turn < ROUNDS:
            label = components(links)
            named = materialize(shared.join(label.withColumnRenamed("node", "point"), "point", "left").withColumn("label", F.coalesce("label", "point")))
    return links


def with_components(docs: DataFrame, id_col: str = "doc_id", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_hash, component_id, keeper_hash) for every row of docs, as
    simhash.with_components gives them: here two texts are linked if the Jaccard
    similarity of their sets of shingles is 4/5 or more. Texts without a word are
    equal, a null text counts as empty."""
    made = _with_prefix(docs.select(F.col(id_col), "text", F.xxhash64("text").alias("text_hash")), width)
    prints = materialize(made.drop("text"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    points = materialize(prints.groupBy("point").agg(first.alias("first_row"), F.first("print").alias("print"), F.first("n").alias("n"), F.first("first").alias("first")))
    labels = components(_links(docs, points, id_col, width)).withColumnRenamed("node", "point")
    of = points.select("point", "first_row")
    least = labels.join(of, "point").groupBy("label").agg(F.min("first_row").alias("least"))
    joined = labels.join(least, "label").select("point", "least")
    # Cut here, so that the last join has both its shuffles to itself and can split a hot point.
    named = materialize(of.join(joined, "point", "left").select("point", F.coalesce("least", "first_row").alias("least")))
    return prints.select(id_col, "text_hash", "point").join(named, "point").select(
        id_col, "text_hash", F.col("least.id").alias("component_id"), F.col("least.hash").alias("keeper_hash")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", width: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each component of near copies, that of the smallest id,
    by the rules of simhash.keep_one."""
    return keepers(docs, with_components(docs, id_col, width), id_col)
