"""Language-model scores from a hashed maximum-entropy model.

Word counts cover all training documents. Words fall into items: each frequent word
is one, and the rest share items by their ending. Items are the leaves of a tree of
classes within classes, in which items with similar neighbours stand together, and

    P(word | before) = P(class | before) * P(class within | class, before)
                       * P(item | class within, before) * P(word | item).

Each of the first three factors is a softmax over the children of a node. Its logits
are sums of weights of hashed features, each together with the node: the last word,
the last two, and the second and third last alone (skips). The weights are trained in
rounds. In a round every task starts from the same weights, makes gradient steps over
its share of the training documents and sends the changes of the rows it touched; their
means are the next round's start. Documents are turned into numbers once; rounds and
scores read those, many tokens at a time.

Counts of words beyond the bounded head are joined by a shuffle, so no table of
unbounded size is broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Batches, Shared, as_bytes, column, materialize, spaced_words

#: The end of a text, a token that no word equals.
END = b"\n"
#: Children of a node and levels of the tree; its leaves are words that are items of
#: their own, and endings of all others.
BRANCH, LEVELS = 8, 4
ENDINGS, ENDING = 512, 3
ITEMS = BRANCH**LEVELS - ENDINGS
#: Words of so many training tokens keep their identity as context; rarer ones share
#: that of their ending.
LEAST_CONTEXT = 50
#: Features at each level of the tree, in the order of Model.keys. Deeper nodes see
#: little data, and there the last words alone did as well on held-out documents.
FEATURES = [4, 4, 2, 1]
#: Words whose counts are broadcast at most.
HEAD = 1 << 20
#: Frequent words that describe the neighbourhood of items, and words on either side.
NEAR_WORDS, REACH = 64, 2
#: Rows of hashed features, as a power of two, and training rounds; a round reads its
#: share of the training documents once.
ROW_BITS, ROUNDS = 17, 2
ROWS = 1 << ROW_BITS
#: Tokens of a gradient step, its size, and tokens that are scored at a time.
STEP_TOKENS, STEP, BLOCK = 32_768, 0.15, 32_768
#: Tokens of a training task, about: each task sends the rows it touched, so that what
#: a round sends follows the tokens and not the number of partitions.
TASK_TOKENS = 4_000_000
#: Tokens of numbered documents that are taken up at a time, about.
SLICE_TOKENS = 1_000_000
#: Words that a task remembers or counts before it starts afresh.
REMEMBERED = 400_000
SEED = 42

#: A token's number has its item in the upper bits and bits of its word's hash below,
#: so that words of one item differ as context.
_HASH_BITS = 20
_NOTHING = np.uint32(0xFFFFFFFF)
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2C1B3C6D)]

_OWN = ["n_tokens", "n_known", "base_score", "lm_score"]


def tokens(text: bytes) -> list[bytes]:
    words = spaced_words(text)
    words.append(END)
    return words


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each token stands in all these texts. Tasks count what
    they read before anything is shuffled."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                counts.update(tokens(t))
                if len(counts) > REMEMBERED:
                    yield emit(counts)
                    counts.clear()
        yield emit(counts)

    return docs.select(column(text)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most `most` words reach. Counts are looked at in
    logarithmic bins, so the driver gets a short list at any size."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.words
        if total > most:
            break
        least = r.least
    return least if least is not None else 1 << 62


class Lexicon:
    """Counts of the head words and the items of all words; plain arrays. Words are
    looked up by hash and then compared."""

    def __init__(self, words: list[bytes], counts: np.ndarray, least_item: int, total: int, distinct: int) -> None:
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[order], np.asarray(counts, np.int64)[order]
        self.words = b"".join(words[k] for k in order.tolist())
        self.ends = np.cumsum([0, *(len(words[k]) for k in order.tolist())])
        own = np.flatnonzero(self.counts >= least_item)
        self.n_own = len(own)
        self.item = np.full(len(self.counts), -1, np.int64)
        self.item[own] = np.arange(self.n_own)
        self.near = np.full(self.n_own + ENDINGS, -1, np.int64)
        frequent = np.argsort(-self.counts[own], kind="stable")[:NEAR_WORDS]
        self.near[frequent] = np.arange(len(frequent))
        self.total, self.distinct = total, distinct

    def __len__(self) -> int:
        return self.n_own + ENDINGS

    def places(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Where each word stands in the head, or -1."""
        n = len(self.hashes)
        out, todo = np.full(len(words), -1, np.int64), np.arange(len(words))
        at = np.searchsorted(self.hashes, hashes)
        while len(todo):  # once, but for words of one hash
            same = at < n
            same[same] = self.hashes[at[same]] == hashes[todo[same]]
            todo, at = todo[same], at[same]
            equal = np.array([self.words[a:b] == words[k] for k, a, b in zip(todo.tolist(), self.ends[at].tolist(), self.ends[at + 1].tolist())], bool)
            out[todo[equal]] = at[equal]
            todo, at = todo[~equal], at[~equal] + 1
        return out


class Numbering(dict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key: bytes) -> int:
        made = self[key] = len(self)
        return made


class Reader:
    """Numbers of tokens, made once in each task: for each word seen its head count
    (-1: not in the head) and its token number."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.clear()

    def clear(self) -> None:
        self.known = Numbering()
        self.words: list[bytes] = []
        self.count, self.number = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens in words, count and number, and tokens of each text."""
        if len(self.words) > REMEMBERED:
            self.clear()
        listed = [tokens(t) for t in texts]
        sizes = np.array([len(x) for x in listed], np.int64)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(listed)), np.int64, int(sizes.sum()))
        if len(self.known) > len(self.words):
            self._learn(list(islice(self.known, len(self.words), None)))
        return ids, sizes

    def _learn(self, new: list[bytes]) -> None:
        lex = self.lexicon
        h = np.fromiter(map(xxhash.xxh64_intdigest, new, repeat(SEED)), np.uint64, len(new))
        at = lex.places(new, h)
        count, item = np.full(len(new), -1, np.int64), np.full(len(new), -1, np.int64)
        there = at >= 0
        count[there], item[there] = lex.counts[at[there]], lex.item[at[there]]
        rest = np.flatnonzero(item < 0)
        item[rest] = lex.n_own + np.array([zlib.crc32(new[k][-ENDING:]) for k in rest.tolist()], np.int64) % ENDINGS
        h[count < LEAST_CONTEXT] = 0
        number = (item.astype(np.uint32) << np.uint32(_HASH_BITS)) | (h & np.uint64((1 << _HASH_BITS) - 1)).astype(np.uint32)
        self.words += new
        self.count, self.number = np.append(self.count, count), np.append(self.number, number)


def item_of(numbers: np.ndarray) -> np.ndarray:
    return (numbers >> np.uint32(_HASH_BITS)).astype(np.int64)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    step = max(1, batch.num_rows * size // max(size, batch.column(0).nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def number(docs: DataFrame, lexicon: Lexicon, text: str = "text", **marks: Column) -> DataFrame:
    """docs, less the text and less columns of the names this module makes, with
    n_tokens, the known tokens and base score of head words, what the counts of head
    words add within items of endings (__rare), the words beyond the head (__tail), the
    token numbers (__numbers, four bytes each), and the marks. The other columns are
    called __c0 and so on, in their order."""
    kept = _kept(docs, text)
    fields = [
        *(T.StructField(f"__c{k}", docs.schema[c].dataType) for k, c in enumerate(kept)),
        *(T.StructField(m, T.LongType()) for m in marks),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("__rare", T.DoubleType()),
        T.StructField("__tail", T.ArrayType(T.BinaryType())), T.StructField("__numbers", T.BinaryType()),
    ]
    names = [f.name for f in fields]
    work = docs.select(F.coalesce(column(text), F.lit("")).alias("__text"), *(column(c).alias(f"__c{k}") for k, c in enumerate(kept)), *(c.cast("bigint").alias(m) for m, c in marks.items()))
    shared = Shared(docs.sparkSession, lexicon)

    def run(batches: Batches) -> Batches:
        lex = shared.get()
        reader, whole = Reader(lex), np.log10(lex.total + lex.distinct + 1.0)
        for batch in batches:
            for part in _slices(batch, 3_000_000):
                ids, sizes = reader.read(as_bytes(part.column(0)))
                starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
                count, numbers = reader.count[ids], reader.number[ids]
                tail, log = count < 0, np.log10(np.maximum(count, 0) + 1.0)
                rare = np.where(item_of(numbers) >= lex.n_own, log, 0.0)
                known, base, below = (np.add.reduceat(x, starts) if len(starts) else x[:0] for x in (np.where(tail, 0, 1), log - whole, rare))
                edge = np.append(0, np.cumsum(tail))[np.append(0, ends)]
                rest = pa.array([reader.words[i] for i in ids[tail].tolist()], pa.binary())
                data = memoryview(numbers).cast("B")
                packed = pa.array([data[4 * a : 4 * b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())
                made = [pa.array(sizes), pa.array(known), pa.array(base), pa.array(below), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), rest), packed]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=names)

    return work.mapInArrow(run, T.StructType(fields))


def _kept(docs: DataFrame, text: str) -> list[str]:
    gone = {text.lower(), *_OWN}
    return [c for c in docs.columns if c.lower() not in gone]


def _parts(array: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token numbers and sizes of some documents at a time, about SLICE_TOKENS."""
    held, size = [], 0
    for data in array.to_pylist():
        held.append(np.frombuffer(data, np.uint32))
        size += len(held[-1])
        if size >= SLICE_TOKENS:
            yield np.concatenate(held), np.array([len(x) for x in held], np.int64)
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held], np.int64)


def near_counts(numbered: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(cell, n): how often the frequent words stand within REACH words of each item."""
    shared = Shared(numbered.sparkSession, lexicon)

    def run(batches: Batches) -> Batches:
        lex = shared.get()
        width = NEAR_WORDS + 1
        seen = np.zeros(len(lex.near) * width, np.int64)
        for batch in batches:
            for numbers, _ in _parts(batch.column(0)):
                item = item_of(numbers)
                near = lex.near[item]
                for gap in range(1, REACH + 1):
                    for a, b in ((item[:-gap], near[gap:]), (item[gap:], near[:-gap])):
                        good = b >= 0
                        seen += np.bincount(a[good] * width + b[good], minlength=len(seen))
                seen += np.bincount(item * width + NEAR_WORDS, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    return numbered.select("__numbers").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def leaves(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A leaf for each item. All items are halved again and again along the direction
    in which the square roots of their neighbours' shares differ most, weighted by the
    items' tokens; so a node's items are alike and no node has more than its leaves."""
    x = np.sqrt(near / np.maximum(1, near.sum(axis=1, keepdims=True)))
    heavy = np.log1p(weight) + 1e-3
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), BRANCH**LEVELS, 0)]
    while todo:
        at, room, first = todo.pop()
        if len(at) <= 1:
            out[at] = first
            continue
        w = heavy[at][:, None]
        centred = x[at] - (x[at] * w).sum(axis=0) / w.sum()
        along = np.linalg.eigh((centred * w).T @ centred)[1][:, -1]
        order = at[np.argsort(centred @ along * np.sign(along[np.argmax(np.abs(along))]), kind="stable")]
        half = len(at) // 2
        todo += [(order[:half], room // 2, first), (order[half:], room // 2, first + room // 2)]
    return out


class Model:
    """Weights of hashed features, and biases of the tree's nodes; plain arrays."""

    def __init__(self, lexicon: Lexicon, leaf: np.ndarray, item_tokens: np.ndarray, ending_tokens: np.ndarray, ending_words: np.ndarray) -> None:
        # P(word | item) is (count + 1) / (tokens + words + 1) in items of endings; the
        # numerator of words beyond the head is added after the join.
        self.log_below = np.zeros(len(leaf))
        self.log_below[lexicon.n_own :] = -np.log(ending_tokens + ending_words + 1.0)
        self.n_own = lexicon.n_own
        self.digit = np.stack([leaf // BRANCH ** (LEVELS - 1 - k) % BRANCH for k in range(LEVELS)])
        # Nodes of a level follow those of the level above.
        self.node = np.stack([(BRANCH**k - 1) // (BRANCH - 1) + leaf // BRANCH ** (LEVELS - k) for k in range(LEVELS)])
        tokens_below = np.zeros(((BRANCH**LEVELS - 1) // (BRANCH - 1), BRANCH))
        leaves_below = np.zeros_like(tokens_below)
        for k in range(LEVELS):
            np.add.at(tokens_below, (self.node[k], self.digit[k]), item_tokens + 1.0)
            np.add.at(leaves_below, (self.node[k], self.digit[k]), 1)
        share = tokens_below / np.maximum(tokens_below.sum(axis=1, keepdims=True), 1e-9)
        # A child without leaves gets no share worth speaking of.
        self.bias = np.where(leaves_below > 0, np.log(np.maximum(share, 1e-12)), -40.0).astype(np.float32)
        self.weights = np.zeros((ROWS, BRANCH), np.float32)

    def keys(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The features of each token: the last word, the last two, the second and the
        third last alone. Before a text stands nothing."""
        n, starts = len(numbers), np.cumsum(sizes) - sizes
        back = []
        for gap in (1, 2, 3):
            b = np.full(n, _NOTHING, np.uint32)
            b[gap:] = numbers[:-gap] if gap < n else numbers[:0]
            for k in range(gap):
                b[(starts + k)[k < sizes]] = _NOTHING
            back.append(b)
        one, two, three = back
        out = np.stack([one * _MIX[0], (one * _MIX[1] + two) * _MIX[2] + np.uint32(1), two * _MIX[3] + np.uint32(2), three * _MIX[4] + np.uint32(3)])
        out ^= out >> np.uint32(15)
        return out

    def rows(self, keys: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of weights of features at these nodes."""
        mixed = (keys ^ (node.astype(np.uint32) * _MIX[0])) * _MIX[5]
        mixed ^= mixed >> np.uint32(13)
        return ((mixed * _MIX[2]) >> np.uint32(32 - ROW_BITS)).astype(np.int64)

    def bounded(self) -> bool:
        """Whether no logit can leave the range that exp() of a float takes."""
        return max(FEATURES) * float(np.abs(self.weights).max()) + float(np.abs(self.bias).max()) < 80

    def logits(self, rows: np.ndarray, node: np.ndarray, bounded: bool) -> np.ndarray:
        """A column for each child, less the largest where that is needed."""
        out = self.weights.take(rows[0], axis=0)
        for r in rows[1:]:
            out += self.weights.take(r, axis=0)
        out += self.bias.take(node, axis=0)
        if not bounded:
            out -= out.max(axis=1, keepdims=True)
        return out

    def log_item(self, keys: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Log probability of each token's item."""
        out, bounded, ones = np.zeros(len(item)), self.bounded(), np.ones(BRANCH, np.float32)
        for at in range(0, len(item), BLOCK):
            k, i = keys[:, at : at + BLOCK], item[at : at + BLOCK]
            each = np.arange(len(i))
            for level in range(LEVELS):
                node = self.node[level][i]
                z = self.logits(self.rows(k[: FEATURES[level]], node), node, bounded)
                own = z[each, self.digit[level][i]].astype(np.float64)
                np.exp(z, out=z)
                out[at : at + BLOCK] += own - np.log(z @ ones)
        return out

    def gradient(self, keys: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that these tokens touch, and the sums of their gradients."""
        out = self.slopes(keys, item)
        at = np.flatnonzero(out.any(axis=1))
        return at, out[at]

    def slopes(self, keys: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The sums of the gradients of these tokens, for every row."""
        each, bounded, errors, touched = np.arange(len(item)), self.bounded(), [], []
        for level in range(LEVELS):
            node = self.node[level][item]
            touched.append(self.rows(keys[: FEATURES[level]], node))
            z = np.ascontiguousarray(self.logits(touched[-1], node, bounded).T)
            np.exp(z, out=z)
            z /= -z.sum(axis=0)
            z[self.digit[level][item], each] += 1
            errors.append(z)
        flat = np.concatenate(touched).ravel()
        out, spread = np.empty((ROWS, BRANCH), np.float32), np.empty((sum(FEATURES), len(item)))
        of = np.cumsum([0, *FEATURES])
        for child in range(BRANCH):
            for level in range(LEVELS):
                spread[of[level] : of[level + 1]] = errors[level][child]
            out[:, child] = np.bincount(flat, spread.ravel(), ROWS)
        return out


def _train_round(numbered: DataFrame, model: Model) -> None:
    """One round of distributed gradient updates over these documents. A row's change
    is the mean of those of the tasks that touched it."""
    start = Shared(numbered.sparkSession, model)
    columns = [f"c{k}" for k in range(BRANCH)]

    def run(batches: Batches) -> Batches:
        own = start.get()
        before = own.weights
        own.weights, square = before.copy(), np.full((ROWS, BRANCH), 1e-3, np.float32)
        for batch in batches:
            for numbers, sizes in _parts(batch.column(0)):
                keys, item = own.keys(numbers, sizes), item_of(numbers)
                for a in range(0, len(item), STEP_TOKENS):
                    g = own.slopes(keys[:, a : a + STEP_TOKENS], item[a : a + STEP_TOKENS])
                    square += g * g
                    g *= STEP
                    g /= np.sqrt(square)
                    own.weights += g
        at = np.flatnonzero((own.weights != before).any(axis=1))
        change = own.weights[at] - before[at]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(change[:, k])) for k in range(BRANCH))], names=["row", *columns])

    schema = "row int, " + ", ".join(f"{c} float" for c in columns)
    sums = numbered.select("__numbers").mapInArrow(run, schema).groupBy("row").agg(F.count("*").alias("tasks"), *[F.sum(c).alias(c) for c in columns])
    means = sums.select("row", *[(F.col(c) / F.col("tasks")).cast("float").alias(c) for c in columns]).toArrow()
    if means.num_rows:
        at = means.column("row").to_numpy()
        model.weights[at] += np.column_stack([means.column(c).to_numpy() for c in columns])


def fit_lexicon(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Lexicon]:
    """The counts of all tokens of these texts, and the lexicon. Null texts count as
    empty; without rows every token is unknown."""
    counts = materialize(count_words(docs, text))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    least, least_item = _least_count(counts, HEAD), _least_count(counts, ITEMS)
    head = counts.where(F.col("n") >= least).toArrow()
    return counts, Lexicon(head.column("word").to_pylist(), head.column("n").to_numpy(), least_item, total or 0, distinct)


def fit_model(numbered: DataFrame, counts: DataFrame, lexicon: Lexicon, turn: str = "__turn") -> Model:
    """The model, trained on these documents as number() made them; `turn` holds the
    round that reads each. Without rows it says what the counts say. A round's weights
    are the mean of its tasks', so scores depend a little on how rows are dealt to tasks;
    a word of fewer than LEAST_CONTEXT training tokens has no weights of its own as
    context, though its own count and score are its own."""
    numbered = numbered.coalesce(1 + lexicon.total // TASK_TOKENS)
    least_item = int(lexicon.counts[lexicon.item >= 0].min()) if lexicon.n_own else 1 << 62
    ending = F.pmod(F.crc32(F.substring("word", -ENDING, ENDING)), F.lit(ENDINGS)).alias("e")
    endings = np.zeros((ENDINGS, 2))
    for r in counts.where(F.col("n") < least_item).groupBy(ending).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        endings[r.e] = r.n, r.v
    cells = np.zeros(len(lexicon) * (NEAR_WORDS + 1))
    near = near_counts(numbered, lexicon).toArrow()
    cells[near.column("cell").to_numpy()] = near.column("n").to_numpy()
    cells = cells.reshape(-1, NEAR_WORDS + 1)
    model = Model(lexicon, leaves(cells[:, :-1], cells[:, -1]), cells[:, -1], endings[:, 0], endings[:, 1])
    for k in range(ROUNDS):
        _train_round(numbered.where(F.col(turn) == k), model)
    return model


def turn_of(id_col: str) -> Column:
    """The round that reads a document, by its id."""
    return F.pmod(F.xxhash64(column(id_col)), F.lit(ROUNDS))


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, Lexicon, Model]:
    """The counts of all training tokens, the lexicon and the trained model."""
    own = docs.where(training).select(column(id_col), column(text))
    counts, lexicon = fit_lexicon(own, text)
    numbered = materialize(number(own, lexicon, text, __turn=turn_of(id_col)))
    return counts, lexicon, fit_model(numbered, counts, lexicon)


def score_numbered(numbered: DataFrame, counts: DataFrame, lexicon: Lexicon, model: Model, names: list[str]) -> DataFrame:
    """Scores of documents that number() made and a checkpoint holds, with a column
    __row that tells them apart; `names` are the names of __c0 and so on."""
    fitted = Shared(numbered.sparkSession, model)
    kept = [f"__c{k}" for k in range(len(names))]
    work = numbered.select("__numbers", *kept, "__row", "n_tokens", "n_known", "base_score", "__rare")
    fields = [*(work.schema[c] for c in work.columns[1:]), T.StructField("lm_score", T.DoubleType())]

    def run(batches: Batches) -> Batches:
        m = fitted.get()
        for batch in batches:
            made = [np.zeros(0)]
            for numbers, sizes in _parts(batch.column(0)):
                item = item_of(numbers)
                log = (m.log_item(m.keys(numbers, sizes), item) + m.log_below[item]) / np.log(10)
                made.append(np.add.reduceat(log, np.cumsum(sizes) - sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(made))], names=[f.name for f in fields])

    scored = work.mapInArrow(run, T.StructType(fields))
    words = numbered.select("__row", F.explode("__tail").alias("word")).groupBy("__row", "word").agg(F.count("*").alias("k"))
    found = words.join(counts, "word", "left").groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more")
    )
    joined = scored.join(found, "__row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        *[F.col(c).alias(n) for c, n in zip(kept, names)], "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + more).alias("base_score"), (F.col("lm_score") + F.col("__rare") + more).alias("lm_score"),
    )


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, model: Model, text: str = "text") -> DataFrame:
    """docs, less the text, with n_tokens, n_known, base_score and lm_score: log10
    probabilities of the whole text, its end counted, under add-one word counts and
    under the model.

    A null text is scored as an empty one. Columns of the new names, in any case, are
    replaced. Repeated rows get equal scores, and equally frequent words are all items
    or all not. An empty table gives no rows."""
    numbered = materialize(number(docs, lexicon, text).withColumn("__row", F.monotonically_increasing_id()))
    return score_numbered(numbered, counts, lexicon, model, _kept(docs, text))


def fit_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, Lexicon]:
    """What score() says of all docs under the model that fit() learns from the
    training rows, and the lexicon; every document is turned into numbers once."""
    counts, lexicon = fit_lexicon(docs.where(training).select(column(text)), text)
    made = number(docs, lexicon, text, __turn=turn_of(id_col), __train=training)
    numbered = materialize(made.withColumn("__row", F.monotonically_increasing_id()))
    model = fit_model(numbered.where("__train = 1"), counts, lexicon)
    return score_numbered(numbered, counts, lexicon, model, _kept(docs, text)), lexicon
