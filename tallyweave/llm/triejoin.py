"""Similarity join of word n-gram sets (Jaccard 0.9 or more) in prefix trees.

All n-grams have one global order, rare ones first, and a set is the ascending list of
its n-grams. Sets that are similar enough share an n-gram among the first tenth of
each. Of all sets of about one size that hold an n-gram there, one is its pivot, and all
meet in the pivot's shard; n-grams with one pivot cost a set one row. A shard stores its
sets in a trie. One traversal compares all its sets with all: a node's n-grams add to the
overlap of every set with the node's path, which all sets below share; a subtree is left
when what remains of the longest set below it and of the other cannot make up what is
missing. Subtrees whose sets are all connected with a set already are left as well, so
that a group of near copies costs little more than its size.

Each shard is joined twice: first as a trie of the shared n-grams of the first tenths
alone, with their places and the sizes of what remains, which parts it into the few groups
of sets that may be similar, and then each of those as a trie of whole sets. A shard that is too large is dealt out in chunks,
each with the pivot. What its chunks have not connected is then compared in pairs of
chunks; sets of the shard's largest component are not compared with each other again.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Batches, as_bytes, bit_filter, column, hash_fraction, in_filter, materialize, rewritten, spaced_words
from tallyweave.llm.simhash import components

WIDTH = 3
#: Share of the texts whose n-grams are counted for the order (all of them), and the counts
#: from which on an n-gram is of the next class of frequent ones. This changes the work
#: only. So many bytes of text are counted in one bucket, about.
COUNTED, OFTEN, BUCKET_BYTES = 1.0, (2, 4, 16, 128), 16_000_000
#: n-grams of a shard, of which each set ships a tenth first, and SET_COST more a set.
SHARD_TOKENS, SET_COST = 3_000_000, 64
SLICE_BYTES = 4_000_000
#: Bits of the filters of n-grams and of rows. Smaller ones let more through to the joins.
FILTER_BITS = 1 << 26
#: Sizes of one class differ by less than a tenth, so similar sets' classes by one at most.
CLASS = math.log(10 / 9) * 1.0001
#: Shards of so few sets are compared pair by pair.
FEW = 6
_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of words in a row, from the words' hashes."""
    key = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        key = (key + part) * _MIX[k % len(_MIX)]
        key ^= key >> np.uint64(31)
    return key


def ngram_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct n-grams of each text as ascending hashes; a text of fewer words is
    one n-gram, one without words none."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(spaced_words, texts)]
    mix = xxhash.xxh64_intdigest
    hashes = np.array([mix(w) for w in number] or [0], np.uint64) | np.uint64(1)
    out = []
    for ids in parts:
        own, n = hashes[ids], min(width, len(ids))
        out.append(np.unique(_mixed([own[k : len(own) - n + k + 1] for k in range(n)])) if n else own)
    return out


def ordered(own: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """A set in the global order: a token is its class of frequency in the highest byte
    and 56 bits of its hash below. The classes' filters may take a token for a more
    frequent one, and do so wherever it stands."""
    level = np.zeros(len(own), np.uint64)
    some = np.arange(len(own))
    for bits in frequent:
        some = some[in_filter(bits, own[some])]
        if not len(some):
            break
        level[some] += np.uint64(1)
    return np.unique((level << np.uint64(56)) | (own >> np.uint64(8)))


def prefix_size(n: int) -> int:
    """So many first tokens meet those of any set of similarity 0.9 or more."""
    return n - (9 * n + 9) // 10 + 1


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with so many common tokens have 0.9 or more."""
    return 19 * both >= 9 * (a + b)


def _ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


class Trie:
    """Ascending sets in lexicographic order; a subtree is a range of them. Of a set may
    be given some of its first tokens alone, the last of these included: `ranks` tells
    which of the set's tokens each is, from 1 on, and `sizes` are those of whole sets.
    Guests are not linked with each other."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, ranks: list[np.ndarray] | None = None, guests: np.ndarray | None = None) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        own = [sets[i] for i in self.order]
        self.ranks = np.concatenate([np.arange(1, len(s) + 1) for s in own] if ranks is None else [ranks[i] for i in self.order])
        self.sizes, self.given = sizes[self.order].astype(np.int64), np.array([len(s) for s in own], np.int64)
        self.starts = np.cumsum(self.given) - self.given
        self.ids = np.unique(np.concatenate(own), return_inverse=True)[1]
        self.width = int(self.ids.max()) + 1
        of = np.repeat(np.arange(len(own)), self.given)
        self.places = of * self.width + self.ids
        self.last = self.ids[self.starts + self.given - 1]
        self.holders = of[np.argsort(self.ids, kind="stable")]
        self.held = np.bincount(self.ids, minlength=self.width)
        self.first = np.cumsum(self.held) - self.held
        self.shared = np.zeros(len(own), np.int64)  # leading tokens in common with the set before
        for k in range(1, len(own)):
            n = min(self.given[k - 1], self.given[k])
            differs = own[k - 1][:n] != own[k][:n]
            self.shared[k] = differs.argmax() if differs.any() else n
        self.labels = np.unique(labels[self.order], return_inverse=True)[1].astype(np.int64)
        self.guests = np.zeros(len(own), bool) if guests is None else guests[self.order]
        self.links: list[tuple[int, np.ndarray]] = []

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of these tokens each set has."""
        return np.bincount(self.holders[_ranges(self.first[tokens], self.held[tokens])], minlength=len(self.sizes))

    def passed(self, who: np.ndarray, token: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each set come no later than this one, at least, and
        whether that are all that are given."""
        upto = np.searchsorted(self.places, who * self.width + token, "right")
        return np.where(upto > self.starts[who], self.ranks[upto - 1], 0), upto == self.starts[who] + self.given[who]

    def _connect(self, one: int, who: np.ndarray, have: np.ndarray) -> None:
        """Links a set to those that are or, by their first tokens, may be similar."""
        upto = np.minimum(self.last[who], self.last[one])
        own, other = self.passed(np.full(len(who), one), upto)[0], self.passed(who, upto)[0]
        most = have + np.minimum(self.sizes[who] - other, self.sizes[one] - own)
        others = who[similar(most, self.sizes[who], self.sizes[one]) & (self.labels[who] != self.labels[one]) & ~(self.guests[who] & self.guests[one])]
        if len(others):
            self.links.append((one, others[np.unique(self.labels[others], return_index=True)[1]]))
            self.labels[np.isin(self.labels, self.labels[others])] = self.labels[one]

    def join(self) -> list[tuple[int, int]]:
        """Links that connect what all similar pairs connect, besides the labels."""
        n, starts, ids = self.sizes, self.starts, self.ids
        every = np.arange(len(n))
        # The set whose tokens are the most widespread connects a group of copies at once.
        middle = int(np.argmax(np.add.reduceat(self.held[ids], starts) / self.given))
        self._connect(middle, every, self.overlaps(ids[starts[middle] : starts[middle] + self.given[middle]]))
        todo = [(0, len(n), 0, every, np.zeros(len(n), np.int64))]
        while todo:
            low, high, depth, who, have = todo.pop()
            label = self.labels[low]
            open_ = who < high
            if (self.labels[low:high] == label).all():
                open_ &= self.labels[who] != label
            who, have = who[open_], have[open_]
            least, most = n[low:high].min(), n[low:high].max()
            fits = (10 * most >= 9 * n[who]) & (9 * least <= 10 * n[who])
            who, have = who[fits], have[fits]
            if not len(who):
                continue
            end = int(self.given[low]) if high - low == 1 else int(min(self.shared[low + 1 : high].min(), self.given[low]))
            if end > depth:
                path = ids[starts[low] + depth : starts[low] + end]
                have = have + self.overlaps(path)[who]
                passed, over = self.passed(who, path[-1])
                below = (n[low:high] - self.ranks[starts[low:high] + end - 1]).max()
                left = np.where(over, n[who] - passed, np.minimum(n[who] - passed, below))
                able = similar(have + left, n[who], least)
                who, have = who[able], have[able]
            if high - low == 1:
                self._connect(low, who, have)
            elif len(who):
                cut = np.flatnonzero(self.shared[low + 1 : high] == end) + low + 1
                bounds = [low, *cut.tolist(), high]
                todo += [(a, b, end, who, have) for a, b in zip(bounds, bounds[1:])][::-1]
        return [(self.order[one], self.order[other]) for one, others in self.links for other in others.tolist()]


def _slices(batches: Batches, wanted: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Batches:
    """Batches of about SLICE_BYTES, of wanted rows."""
    for batch in batches:
        if wanted:
            batch = batch.filter(pa.array(wanted(batch)))
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _rows(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _frequent(docs: DataFrame, width: int) -> list[np.ndarray]:
    """A filter of the n-grams of each class of frequent ones, by the counts of all texts.
    A bucket has the n-grams of a range of the filters' numbers, so it gives those numbers
    and no n-gram leaves it."""
    drawn = docs.where(hash_fraction(F.col("text")) < COUNTED).select("text")
    size = drawn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    numbers, six = FILTER_BITS // 64, np.uint64(6)
    buckets = np.uint64(min(numbers, max(12, math.ceil(size / BUCKET_BYTES))))

    def place(own: np.ndarray) -> np.ndarray:
        return (own & np.uint64(64 * numbers - 1)) >> six

    def pack(batches: Batches) -> Batches:
        for batch in _slices(batches):
            own, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *ngram_sets(as_bytes(batch.column(0)), width)]), return_counts=True)
            bucket = place(own) * buckets // np.uint64(numbers)
            order = np.argsort(bucket, kind="stable")
            at = [i for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(i)]
            n = np.minimum(n, OFTEN[-1]).astype(np.uint16)
            out = [[int(bucket[i[0]]) for i in at], [own[i].tobytes() for i in at], [n[i].tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "counts"])

    def fold(table: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
        order = np.argsort(token)
        token, n = token[order], n[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        own, n = token[first], np.add.reduceat(n, first, dtype=np.int64)
        out: list[list[np.ndarray]] = [[], [], []]
        for k, least in enumerate(OFTEN):
            some = own[n >= least]
            if len(some):
                some = some[np.argsort(place(some))]
                at = place(some)
                head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (some & np.uint64(63)), head)
                for held, x in zip(out, (np.full(len(head), k), at[head].astype(np.int64), bits.view(np.int64))):
                    held.append(x)
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in zip(("level", "at", "bits"), out)})

    counted = drawn.mapInArrow(pack, "bucket bigint, tokens binary, counts binary").groupBy("bucket").applyInArrow(fold, "level bigint, at bigint, bits bigint")
    counted = rewritten(counted, "frequent")
    filters = []
    for k in range(len(OFTEN)):
        rows = counted.where(F.col("level") == k).select("at", "bits").toArrow()
        filters.append(np.zeros(numbers, np.int64))
        filters[k][rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return [x.view(np.uint64) for x in filters]


def _prints(docs: DataFrame, told, width: int) -> DataFrame:
    """(id, key, point, n, first): a hash of id and text, one of the set, the set's size
    and its first tokens."""

    def run(batches: Batches) -> Batches:
        for batch in _slices(batches):
            own, key, texts = batch.columns
            sets = [ordered(s, told.value) for s in ngram_sets(as_bytes(texts), width)]
            point = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            first = _rows([s[: prefix_size(len(s))] if len(s) else s for s in sets])
            yield pa.RecordBatch.from_arrays([own, key, pa.array(point.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), first], names=["id", "key", "point", "n", "first"])

    longs = [T.StructField(c, T.LongType()) for c in ("key", "point", "n")]
    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *longs, T.StructField("first", T.ArrayType(T.LongType()))]))


def _sets(docs: DataFrame, wanted: DataFrame, told, width: int) -> DataFrame:
    """(point, own) of the wanted points, whose key is that of one row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "key", FILTER_BITS))

    def run(batches: Batches) -> Batches:
        for batch in _slices(batches, lambda b: in_filter(shared.value, b.column(0).to_numpy().view(np.uint64))):
            sets = [ordered(s, told.value) for s in ngram_sets(as_bytes(batch.column(1)), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(sets)], names=["key", "own"])

    made = docs.select("key", "text").mapInArrow(run, "key bigint, own array<bigint>")
    return made.join(wanted, "key").dropDuplicates(["point"]).select("point", "own")


def _shared(prints: DataFrame) -> DataFrame:
    """(point, key, n, size, tokens, ranks) of every set that shares one of its first
    tokens: those that another set may have, and the last. `size` is its class."""
    tokens = prints.where("n > 0").select("point", F.explode("first").alias("token"))
    heads = tokens.groupBy("token").agg(F.min("point").alias("low"), F.max("point").alias("high")).where("low <> high")
    shared = prints.sparkSession.sparkContext.broadcast(bit_filter(heads, "token", FILTER_BITS))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            many = batch.column(3).value_lengths().to_numpy()
            token, of = batch.column(3).flatten().to_numpy(), np.repeat(np.arange(len(many)), many)
            ends = np.cumsum(many)
            good = in_filter(shared.value, token.view(np.uint64))
            some = np.bincount(of[good], minlength=len(many)) > 0
            rank = np.arange(len(token)) - np.repeat(ends - many, many) + 1
            good[ends - 1] = True
            good &= some[of]
            size = np.floor(np.log(batch.column(2).to_numpy()) / CLASS).astype(np.int32)[some]
            held = pa.array(np.append(0, np.cumsum(np.bincount(of[good], minlength=len(many))[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(held, pa.array(x[good])) for x in (token, rank.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(some)) for c in batch.columns[:3]), pa.array(size), *lists], names=["point", "key", "n", "size", "tokens", "ranks"])

    made = prints.where("n > 0").select("point", "key", "n", "first").mapInArrow(run, "point bigint, key bigint, n bigint, size int, tokens array<bigint>, ranks array<int>")
    return rewritten(made.dropDuplicates(["point"]), "shared")


def _met(lists: DataFrame) -> DataFrame:
    """(pivot, class, point): the shards of every set that shares a first token with
    another one of about its size."""
    rows = lists.select("point", "size", F.explode("tokens").alias("token"))
    placed = rows.select("token", "point", "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("guest"))
    placed = placed.select("token", "point", "guest", (F.col("size") + F.col("guest")).alias("class"))
    pivots = placed.groupBy("token", "class").agg(F.min("point").alias("pivot"), F.max("point").alias("high"), F.min("guest").alias("guests"))
    pivots = pivots.where("pivot <> high and guests = 0").select("token", "class", "pivot")
    return rewritten(placed.join(pivots, ["token", "class"]).select("pivot", "class", "point").distinct(), "met")


_SHARD = ["pivot", "class", "x", "y"]


def _shards(table: pa.Table, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, points and labels of each shard in a table of several; a point once."""
    point, label = table.column("point").to_numpy(), table.column("label").to_numpy()
    columns = [point, *(table.column(c).to_numpy() for c in reversed(names))]
    order = np.lexsort(columns)
    ordered_ = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered_])
    shard = np.ones(len(order), bool)
    shard[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered_[1:]])
    order, shard = order[new], shard[new]
    for at in np.split(order, np.flatnonzero(shard)[1:]):
        yield at, point[at], label[at]


def may_link(a: tuple[set, list, list, int], b: tuple[set, list, list, int]) -> bool:
    """Whether two sets may be similar, by some of their first tokens (as a set and as a
    list), their ranks and the sizes."""
    n, m = a[3], b[3]
    if 10 * min(n, m) < 9 * max(n, m):
        return False
    upto = min(a[1][-1], b[1][-1])
    left = min(x[3] - (x[2][k - 1] if (k := bisect_right(x[1], upto)) else 0) for x in (a, b))
    return 19 * (len(a[0] & b[0]) + left) >= 9 * (n + m)


def _may_join(sets: list[np.ndarray], ranks: list[np.ndarray], sizes: np.ndarray, guests: np.ndarray) -> list[tuple[int, int]]:
    if len(sets) > FEW:
        return Trie(sets, sizes, np.arange(len(sets)), ranks, guests).join()
    rows = [(set(x := s.tolist()), x, r.tolist(), int(n)) for s, r, n in zip(sets, ranks, sizes)]
    return [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if not (guests[i] and guests[j]) and may_link(a, b)]


def _joined(docs: DataFrame, members: DataFrame, lists: DataFrame, told, width: int, buckets: int) -> DataFrame:
    """(a, b) links of the members (pivot, class, x, y, point, label) of each shard;
    members of one label are connected before. Small shards share a task's group."""

    def part(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(len(_SHARD) + 3)]
        shard = [table.column(c).to_numpy() for c in _SHARD]
        tokens, ranks = (table.column(c).combine_chunks() for c in ("tokens", "ranks"))
        ends, flat, rank = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64), ranks.values.to_numpy()
        n, guest = table.column("n").to_numpy(), table.column("size").to_numpy() != shard[1]
        for at, point, label in _shards(table, _SHARD):
            if len(at) < 2:
                continue
            group, spans = np.arange(len(at)), [slice(ends[i], ends[i + 1]) for i in at.tolist()]
            for a, b in _may_join([flat[x] for x in spans], [rank[x] for x in spans], n[at], guest[at]):
                if group[a] != group[b]:
                    group[group == group[b]] = group[a]
            some = np.bincount(group, minlength=len(at))[group] > 1
            for held, x in zip(out, [*(c[at] for c in shard), group.astype(np.int32), point, label]):
                held.append(x[some])
        return pa.table({c: np.concatenate([np.zeros(0, t), *x]) for (c, t), x in zip(told_of.items(), out)})

    def exact(table: pa.Table) -> pa.Table:
        links = [np.zeros((0, 2), np.int64)]
        own = table.column("own").combine_chunks()
        ends, flat = own.offsets.to_numpy(), own.values.to_numpy().view(np.uint64)
        for at, point, label in _shards(table, [*_SHARD, "part"]):
            sets = [flat[ends[i] : ends[i + 1]] for i in at.tolist()]
            found = Trie(sets, np.array([len(s) for s in sets]), label).join() if len(at) > 1 else []
            links.append(point[np.array(found, np.int64).reshape(-1, 2)])
        pairs = np.concatenate(links)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    told_of = {"pivot": np.int64, "class": np.int32, "x": np.int32, "y": np.int32, "part": np.int32, "point": np.int64, "label": np.int64}
    bucket = F.pmod(F.xxhash64(*_SHARD), F.lit(buckets)).alias("bucket")
    given = members.join(lists.select("point", "n", "size", "tokens", "ranks"), "point").select("*", bucket)
    parts = materialize(given.groupBy("bucket").applyInArrow(part, "pivot bigint, class int, x int, y int, part int, point bigint, label bigint"))
    wanted = materialize(lists.join(parts.select("point").distinct(), "point").select("point", "key"))
    sets = _sets(docs, wanted, told, width)
    bucket = F.pmod(F.xxhash64(*_SHARD, "part"), F.lit(buckets)).alias("bucket")
    return materialize(parts.join(sets, "point").select("*", bucket).groupBy("bucket").applyInArrow(exact, "a bigint, b bigint"))


def _links(docs: DataFrame, prints: DataFrame, told, width: int) -> DataFrame:
    """(a, b) links of points."""
    lists, shard = _shared(prints), ["pivot", "class"]
    met = _met(lists).join(lists.select("point", "n"), "point")
    cost = F.sum(F.col("n") + SET_COST).alias("cost")
    sized = materialize(met.groupBy(*shard).agg(cost).withColumn("chunks", F.ceil(F.col("cost") / SHARD_TOKENS).cast("int")))
    buckets = max(12, math.ceil(2 * (sized.agg(F.sum("cost")).first()[0] or 0) / SHARD_TOKENS))
    chunk = lambda n: F.pmod(F.xxhash64("point"), n).cast("int")
    spread = F.when(F.col("point") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk(F.col("chunks"))))
    members = met.join(sized, shard).select(*shard, "point", F.explode(spread).alias("x"), F.lit(0).alias("y"), F.col("point").alias("label"))
    links = _joined(docs, members, lists, told, width, buckets)

    hot = met.join(sized.where("chunks > 1").select(*shard), shard)
    if hot.isEmpty():
        return links
    label = components(links).withColumnRenamed("node", "point")
    named = materialize(hot.join(label, "point", "left").withColumn("label", F.coalesce("label", "point")))
    by = named.groupBy(*shard, "label").agg(cost)
    main = by.groupBy(*shard).agg(F.max_by("label", F.struct("cost", "label")).alias("main"), F.max("cost").alias("m"), (F.sum("cost") - F.max("cost")).alias("r"))
    km, kr = (F.ceil(F.col(c) / (SHARD_TOKENS // 2)).cast("int").alias(f"k{c}") for c in ("m", "r"))
    dealt = named.join(main.where("r > 0").select(*shard, "main", km, kr), shard)
    # Chunk i of the main component meets each chunk j of the rest; chunks of the rest meet each other.
    dealt = dealt.withColumn("own", F.when(F.col("label") == F.col("main"), chunk(F.col("km"))).otherwise(chunk(F.col("kr"))))
    rest = F.sequence(F.lit(0), F.col("kr") - 1)
    as_main = F.transform(rest, lambda j: F.struct(j.alias("x"), F.col("own").alias("y")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("km") - 1), lambda i: F.struct(F.col("own").alias("x"), i.alias("y")))
    with_rest = F.transform(rest, lambda j: F.struct(F.least("own", j).alias("x"), (F.col("km") + F.greatest("own", j)).alias("y")))
    tasks = F.when(F.col("label") == F.col("main"), as_main).otherwise(F.concat(with_main, with_rest))
    members = dealt.select(*shard, "point", "label", F.explode(tasks).alias("t")).select(*shard, "point", "label", "t.x", "t.y")
    return links.union(_joined(docs, members, lists, told, width, buckets))


def with_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs: the size of its set of word
    n-grams, and the smallest id reachable over links of similarity 0.9 or more.

    Words are lower-cased in A-Z. A text of fewer words than an n-gram is one n-gram;
    a null text or one without words has an empty set, which nothing links with, and its
    own id. Equal sets are linked. Null ids take no part in the smallest id; a component
    with null ids only has component_id null. Repeated rows give repeated results, an
    empty table no rows. Other columns, whatever their names, are not read."""
    own = docs.select(column(id_col).alias("id"), column(text).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    told = docs.sparkSession.sparkContext.broadcast(_frequent(own, width))
    prints = rewritten(_prints(own.select("id", "key", "text"), told, width), "ngrams")
    first = F.min("id").alias("first")
    points = materialize(prints.where("n > 0").groupBy("point").agg(first))
    labels = components(_links(own, prints, told, width)).withColumnRenamed("node", "point")
    linked = labels.join(points, "point")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    joined = labels.join(least, "label").select("point", "least")
    # Cut here, so that the last join has both its shuffles to itself and can split a hot point.
    named = materialize(points.join(joined, "point", "left").select("point", F.coalesce("least", "first").alias("component_id")))
    some = prints.where("n > 0").select("id", "n", "point").join(named, "point").select("id", "n", "component_id")
    none = prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
