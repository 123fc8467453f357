"""Benchmark decontamination through suffix arrays of the training text.

Each task turns the words of its documents into shards. A shard's suffix array
sorts the suffixes of all training stretches that could hold a benchmark window:
maximal runs whose neighbouring words stand side by side in some benchmark item.
Any other word cannot belong to a match, so nothing is lost; training text that shares
no two neighbouring words with the benchmark enters no array. Every benchmark suffix
is binary-searched in every shard by its first words; the range it gets names all
places where the window stands. A window is named by its words: items that share it
have it searched for once, and windows that follow each other in every item that has
them are one chain, so that an item meets a document once for each chain. Chains on one
diagonal give the longest verbatim match of an item in a document. Hits are settled
inside the task that holds the document, so documents are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Shared, add_columns, as_bytes, materialize, plain_words, with_columns_of, without

WINDOW = 10
#: Benchmark text, in bytes, that is sent to the tasks at once. A larger benchmark
#: is searched block after block, all documents each time.
BLOCK_BYTES = 32_000_000
#: Bytes of training text in a suffix-array shard, about.
SHARD_BYTES = 6_000_000
#: Benchmark suffixes that are searched for at a time, and chains at items' places that
#: are put together at a time, whole documents each.
SEARCHED, PLACED = 200_000, 500_000

MATCH = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType())]
)
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("n_items", T.LongType()),
    T.StructField("matches", T.ArrayType(MATCH)),
]
_ARROW = [
    pa.int64(),
    pa.list_(pa.list_(pa.int64())),
    pa.list_(pa.string()),
    pa.int64(),
    pa.list_(pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])),
]


def distinct(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the distinct runs of `size` words that begin at these places, in
    order, the number of each place's run, and how often each run stands. Runs are equal
    where the first and the last 2^k words are, and those by doubling."""
    rank, k = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while 2 * k <= size:
        second = np.zeros(len(rank), np.int64)
        second[:-k] = rank[k:] + 1
        rank, k = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1].astype(np.int64), 2 * k
    key = rank[at] * (len(rank) + 2) + rank[at + size - k]
    _, least, of, many = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(least)
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    return at[least[order]], turn[of], many[order]


class Block:
    """Some benchmark items as word numbers, ready to be searched for; a dict of words
    and plain arrays. Distinct windows are numbered by their first places, so that the
    windows of a chain have neighbouring numbers."""

    def __init__(self, rows: Iterator[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str | None] = []
        parts, sizes = [], []
        number = self.vocabulary.setdefault
        for item_id, text in rows:
            words = plain_words((text or "").encode())
            if words:
                parts.append(np.array([*(number(w, len(self.vocabulary)) for w in words), -1], np.int32))
                sizes.append(len(words))
                self.items.append(item_id)
        self.words = np.concatenate([np.zeros(0, np.int32), *parts])  # -1 after each item
        del parts
        sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.window, self.v = window, max(1, len(self.vocabulary))
        self.least = int(min(window, sizes.min(initial=window)))
        pairs = self.pair(self.words[:-1], self.words[1:])
        self.links = np.unique(pairs[pairs >= 0])
        self.table = None
        if self.v * self.v <= 1 << 26:
            self.table = np.zeros(self.v * self.v, bool)
            self.table[self.links] = True
        self.id_rank = np.argsort(np.argsort([i or "" for i in self.items], kind="stable"), kind="stable")
        # All windows by size: where they stand, and which of them are equal.
        room = np.repeat(sizes, sizes + 1) - (np.arange(len(self.words)) - np.repeat(self.starts, sizes + 1))
        whole, short = room >= window, np.zeros(len(self.words), bool)
        short[self.starts[sizes < window]] = True
        self.by_size, first, places, counts = {}, [], [], []
        for size in np.unique(np.append(sizes[sizes < window], [window] if whole.any() else [])).astype(int).tolist():
            at = np.flatnonzero(whole if size == window else short & (room == size))
            least, of, many = distinct(self.words, at, size)
            key = pairs[least] if size > 1 else self.words[least].astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.by_size[size] = (key[order], order + sum(map(len, first)))
            first.append(least)
            places.append(at[np.argsort(of, kind="stable")])
            counts.append(many)
        none = np.zeros(0, np.int64)
        self.first, self.places, self.counts = (np.concatenate([none, *x]) for x in (first, places, counts))
        self.begin = np.cumsum(self.counts) - self.counts
        self.chain = np.cumsum(self._opens())

    def _opens(self) -> np.ndarray:
        """Whether each window begins a chain: it does not follow the one before it in
        the numbering at all places of both."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        number = np.full(len(self.words) + 1, -1, np.int64)
        number[self.places] = np.repeat(np.arange(len(self.first)), self.counts)
        follows = number[self.places + 1] == np.repeat(np.arange(len(self.first)), self.counts) + 1
        always = np.logical_and.reduceat(follows, self.begin)
        opens = np.ones(len(self.first), np.int64)
        opens[1:] = ~(always[:-1] & (self.counts[1:] == self.counts[:-1]))
        return opens

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for two words side by side, -1 if one is none of the items'."""
        return np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.v + b, -1)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item of each window, and the window's first word in it."""
        item = np.searchsorted(self.starts, at, "right") - 1
        return item, at - self.starts[item]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def linked(self, ids: np.ndarray) -> np.ndarray:
        """Whether each word and its successor stand side by side in an item."""
        key = self.pair(ids[:-1], ids[1:])
        known = key >= 0
        if self.table is not None:
            return known & self.table[np.where(known, key, 0)]
        at = np.minimum(np.searchsorted(self.links, key), max(0, len(self.links) - 1))
        return known & (self.links[at] == key if len(self.links) else False)

    def stretches(self, ids: np.ndarray) -> np.ndarray:
        """Positions of the runs of linked words that are as long as the shortest
        window, each run followed by -1. A document ends with a word of -1."""
        if not len(self.items) or not len(ids):
            return np.zeros(0, np.int64)
        joined = self.linked(ids)
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        ends = np.append(starts[1:], len(ids))
        good = (ends - starts >= self.least) & (ids[starts] >= 0)
        starts, sizes = starts[good], (ends - starts)[good]
        if not len(starts):
            return np.zeros(0, np.int64)
        total = int((sizes + 1).sum())
        offset = np.cumsum(sizes + 1) - (sizes + 1)
        out = np.arange(total) - np.repeat(offset, sizes + 1) + np.repeat(starts, sizes + 1)
        out[offset + sizes] = -1
        return out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first `depth` words or more, by
    prefix doubling."""
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        second = np.zeros(len(rank), np.int64)
        second[:-k] = rank[k:] + 1 if k < len(rank) else 0
        rank, k = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1].astype(np.int64), 2 * k
    return np.argsort(rank, kind="stable")


def search(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array in which suffixes begin with each row of wanted."""
    n, size = len(order), wanted.shape[1]
    padded, span = np.concatenate([ids, np.full(size, -2)]), np.arange(size)
    bounds = []
    for after in (False, True):
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            seen = padded[order[np.minimum(mid, n - 1)][:, None] + span]
            differs = seen != wanted
            at = differs.argmax(axis=1)
            row = np.arange(len(wanted))
            right = np.where(differs[row, at], seen[row, at] < wanted[row, at], after)
            low = np.where(open_ & right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        bounds.append(low)
    return bounds[0], bounds[1]


def occurrences(block: Block, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, size, position) of all places where a distinct window stands in these
    words; of each size one at most begins at a word."""
    at = block.stretches(ids)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    words = np.where(at >= 0, ids[at], -1)
    order = suffix_array(words, max(block.by_size))
    pairs = np.unique(block.pair(words[:-1], words[1:]))
    found = [(none, none, none)]
    for size, (keys, windows) in block.by_size.items():
        # A suffix whose first two words never meet here has an empty range.
        here = pairs if size > 1 else np.unique(words)
        low, high = np.searchsorted(keys, here, "left"), np.searchsorted(keys, here, "right")
        some = windows[_ranges(low, high)[0]].astype(np.int64)
        for a in range(0, len(some), SEARCHED):
            wanted = some[a : a + SEARCHED]
            low, high = search(words, order, block.words[block.first[wanted][:, None] + np.arange(size)])
            where, row = _ranges(low, high)
            found.append((wanted[row], np.full(len(row), size), at[order[where]]))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    many = high - low
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many), np.repeat(np.arange(len(low)), many)


def _spans(covered: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).tolist()


def settle(block: Block, texts: list[bytes]) -> Iterator[list[tuple]]:
    """(n_words, hit spans, item ids, items, matches) of each text, in their order, some
    texts at a time."""
    words = [plain_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.full(int((sizes + 1).sum()), -1, np.int64)
    for at, w in zip(starts.tolist(), words):
        ids[at : at + len(w)] = block.ids(w)
    del words
    window, size, position = occurrences(block, ids)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, position, 1)
    np.add.at(change, position + size, -1)
    covered = np.cumsum(change) > 0
    # Neighbouring windows of one chain, one after the other, are one run.
    order = np.lexsort((position, size))
    window, size, position = window[order], size[order], position[order]
    same = np.zeros(len(window), bool)
    same[1:] = (position[1:] == position[:-1] + 1) & (window[1:] == window[:-1] + 1) & (size[1:] == size[:-1])
    same[1:] &= block.chain[window[1:]] == block.chain[window[:-1]]
    run = np.flatnonzero(~same)
    long = np.diff(np.append(run, len(window))) - 1 + size[run]
    window, position = window[run], position[run]
    doc = np.searchsorted(starts, position, "right") - 1
    order = np.argsort(doc, kind="stable")
    doc, window, position, long = doc[order], window[order], position[order], long[order]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    due = np.concatenate([[0], np.cumsum(block.counts[window])])[ends]  # chains at items' places before each text
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(due, due[at] + PLACED, "right")) - 1)
        part = slice(ends[at], ends[upto])
        matches = _longest(block, doc[part], window[part], position[part] - starts[doc[part]], long[part])
        out: list[tuple] = [(int(n), [], [], 0, []) for n in sizes[at:upto]]
        for d, of in matches:
            named = list(dict.fromkeys(m["item_id"] for m in of if m["item_id"] is not None))
            out[d - at] = (int(sizes[d]), _spans(covered[starts[d] : starts[d] + sizes[d]]), named, len(named), of)
        yield out
        at = upto


def _longest(block: Block, doc: np.ndarray, window: np.ndarray, position: np.ndarray, long: np.ndarray) -> Iterator[tuple[int, list[dict]]]:
    """Each document's longest match with each item, by item id."""
    where, row = _ranges(block.begin[window], block.begin[window] + block.counts[window])
    item, start = block.place(block.places[where])
    doc, position, long = doc[row], position[row], long[row]
    order = np.lexsort((position, position - start, item, doc))
    doc, item, start, position, long = (x[order] for x in (doc, item, start, position, long))
    # What overlaps on a diagonal, or touches with all but one of a window's words, goes on.
    diagonal, end = position - start, position + long
    joins = np.zeros(len(doc), bool)
    joins[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] == diagonal[:-1]) & (position[1:] == end[:-1] - block.window + 1)
    first = np.flatnonzero(~joins)
    total = end[np.append(first[1:], len(doc)) - 1] - position[first] if len(first) else end
    doc, item, start, position = doc[first], item[first], start[first], position[first]
    order = np.lexsort((start, position, -total, item, doc))
    doc, item, start, position, total = (x[order] for x in (doc, item, start, position, total))
    best = np.ones(len(doc), bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    doc, item, start, position, total = (x[best] for x in (doc, item, start, position, total))
    order = np.lexsort((block.id_rank[item], doc))
    rows = zip(*(x[order].tolist() for x in (doc, item, total, position, start)))
    for d, of in groupby(rows, key=lambda r: r[0]):
        yield d, [{"item_id": block.items[i], "n_words": n, "doc_word": p, "item_word": s} for _, i, n, p, s in of]


def _merge(a: tuple, b: tuple) -> tuple:
    """What two blocks say of one document."""
    spans: list[list[int]] = []
    for x, y in sorted([*a[1], *b[1]]):
        if spans and x <= spans[-1][1]:
            spans[-1][1] = max(y, spans[-1][1])
        else:
            spans.append([x, y])
    named = sorted({*a[2], *b[2]})
    return a[0], spans, named, len(named), [*a[4], *b[4]]


def _blocks(benchmark: DataFrame) -> Iterator[Iterator[tuple[str | None, str | None]]]:
    """The items, about BLOCK_BYTES of text at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield ((i, t) for batch in table.to_batches(1000) for i, t in zip(*(c.to_pylist() for c in batch.columns)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with n_words, hit_spans (word ranges inside any occurrence of a
    benchmark window), item_ids (as text, sorted, distinct), n_items, and matches:
    for each item the longest verbatim match with its first word in the document
    and in the item; of equally long ones the earliest.

    A null text has no words and no hits. An item without words has no window; an
    item whose id is null can hit but is not named. Repeated documents give
    repeated results; equal items of different ids are all named. An empty benchmark
    hits nothing, an empty table gives no rows. The new columns' names begin with
    `prefix` and replace columns of the same names."""
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]
    names = [f.name for f in fields]
    out = without(docs, names)
    for k, rows in enumerate(_blocks(benchmark)):
        shared = Shared(docs.sparkSession, Block(rows, window))
        if k:
            out = materialize(out)

        def run(batches: Iterator[list[pa.Array]], shared=shared) -> Iterator[list[pa.Array]]:
            block = shared.get()
            for texts, *before in batches:
                at = 0
                for made in settle(block, as_bytes(texts)):
                    if before:
                        made = [_merge(a, b) for a, b in zip(zip(*(x.slice(at, len(made)).to_pylist() for x in before)), made)]
                    at += len(made)
                    yield [pa.array([m[i] for m in made], kind) for i, kind in enumerate(_ARROW)]

        out = add_columns(out, fields, ["text", *(names if k else [])], run, SHARD_BYTES)
    return out


def n_hit(spans: str = "hit_spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs less those that hold a benchmark window; columns as they were."""
    found = find_contamination(docs, benchmark, window, "__leak_")
    return with_columns_of(found.where(F.size("__leak_hit_spans") == 0), docs)
