"""Toxic spans by a linear-chain conditional random field with two states.

Labels mark documents, so a first step turns them into labelled tokens: a token of a
toxic training document is toxic if its word stands in several toxic documents,
copies counted once, and almost nowhere else. The field is trained on those tokens, with features
of the word, its stem and both neighbours. Scoring runs the forward and backward
recursions of whole documents side by side, takes each token's marginal, and turns
the marginals into a calibrated document score and offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import Shared, add_columns, as_bytes, hash_fraction, spaced_words, with_columns_of
from tallyweave.llm.simhash import fingerprint

#: Labelled documents of each label that the field is fitted on, at most about, and the
#: bytes of their texts at most.
SAMPLE, SAMPLE_BYTES = 1000, 16_000_000
#: Tokens of a block of a long chain.
BLOCK = 1024
#: Toxic documents that a toxic word needs, as a share of the toxic sample and at
#: least; and the share of its documents that are toxic. Fingerprints with so many
#: bits different at most are copies.
SUPPORT, LEAST_SUPPORT, PRECISION, COPY_BITS = 0.01, 3, 0.9, 10
#: Buckets of hashed stems, and characters of a stem.
STEMS, STEM = 1 << 12, 5
#: Words with weights of their own need so many tokens in the sample.
LEAST_TOKENS = 3
#: Rounds of gradient ascent, its step, the penalty, and tokens of a training chain.
ROUNDS, STEP, PENALTY, CHAIN = 30, 0.5, 0.3, 400

#: Marginals below this do not count for a document.
NEGLIGIBLE = 0.1

#: Bytes of text that are scored side by side, and words that are kept with their numbers.
#: A token takes some 20 numbers of 8 bytes meanwhile.
SCORED_BYTES, KNOWN_WORDS = 1_000_000, 100_000

_STRIP = b".,;:!?\"'()[]{}*$%&#<>|"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bare(word: bytes) -> bytes:
    """A word without the marks around it."""
    return word.strip(_STRIP)


def stem(word: bytes) -> int:
    return zlib.crc32(word[:STEM]) % STEMS


class Chain:
    """Weights of the field and of the document score; plain arrays and a dict."""

    def __init__(self, words: list[bytes]) -> None:
        self.index = {w: i for i, w in enumerate(words)}
        n = len(words) + 1  # the last is for all other words
        self.word, self.before, self.after = np.zeros(n), np.zeros(n), np.zeros(n)
        self.stem = np.zeros(STEMS)
        self.bias = np.full(1, -5.0)  # an untrained field finds nothing
        self.move = np.zeros((2, 2))
        self.calibration = np.array([-3.0, 6.0])

    def ids(self, words: list[bytes], known: dict[bytes, int], table: list[tuple[int, int]]) -> np.ndarray:
        """A number for each token; table[number] has its word's and stem's index."""
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(out < 0).tolist():
            w = words[k]
            if w not in known:
                b = bare(w)
                known[w] = len(table)
                table.append((self.index.get(b, len(self.index)), stem(b)))
            out[k] = known[w]
        return out

    def local(self, word: np.ndarray, stems: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of the toxic state at each token, from its own features alone."""
        out = self.bias[0] + self.word[word] + self.stem[stems]
        prior, later = np.zeros(len(word)), np.zeros(len(word))
        prior[1:] = self.before[word[:-1]]
        later[:-1] = self.after[word[1:]]
        first = starts[starts < len(word)]
        prior[first] = 0
        later[first[first > 0] - 1] = 0
        return out + prior + later


def _scan(odds: np.ndarray, a: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """y[t] = odds[t] (a01 + a11 y[t - 1]) / (a00 + a10 y[t - 1]) along each chain, odds[t]
    at its first token. Chains run side by side, one position at a time. A long one is
    cut into blocks: the steps of a block make up one 2 x 2 matrix, the matrices tell
    with what value each block begins, and then all blocks run side by side as well."""
    many = -(-sizes // BLOCK)
    chain = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many)
    starts, sizes = starts[chain] + number * BLOCK, np.minimum(BLOCK, sizes[chain] - number * BLOCK)
    enter = np.full(len(starts), np.nan)  # no value before a chain
    followed = np.flatnonzero(number < many[chain] - 1)
    if len(followed):
        w, x, y, z = np.ones(len(followed)), np.zeros(len(followed)), np.zeros(len(followed)), np.ones(len(followed))
        for t in range(BLOCK):
            o = odds[starts[followed] + t]
            w, x, y, z = o * (a[1, 1] * w + a[0, 1] * y), o * (a[1, 1] * x + a[0, 1] * z), a[1, 0] * w + a[0, 0] * y, a[1, 0] * x + a[0, 0] * z
            if not t:  # whatever comes in, a chain's first value is its odds
                first = number[followed] == 0
                w, x, y, z = np.where(first, 0, w), np.where(first, o, x), np.where(first, 0, y), np.where(first, 1, z)
            scale = w + x + y + z
            w, x, y, z = w / scale, x / scale, y / scale, z / scale
        order = np.argsort(number[followed], kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(number[followed][order])) + 1):
            before = np.nan_to_num(enter[followed[at]], nan=1.0)
            enter[followed[at] + 1] = (w[at] * before + x[at]) / (y[at] * before + z[at])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, r = starts[order], sizes[order], enter[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    out = np.ones(len(odds))
    for t in range(longest):
        at = starts[: alive[t]] + t
        r = r[: alive[t]]
        r = odds[at] * ((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]) if t else np.nan_to_num((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), nan=1.0))
        out[at] = r
    return out


def marginals(local: np.ndarray, starts: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward odds and the marginal of the toxic state at each token. The
    backward odds times the token's own follow the forward rule from the other end."""
    a, some = np.exp(move), sizes > 0
    odds = np.exp(np.clip(local, -30, 30))
    forward = _scan(odds, a, starts[some], sizes[some])
    backward = _scan(odds[::-1], a.T, (len(odds) - starts - sizes)[some], sizes[some])[::-1] / odds
    both = forward * backward
    return forward, backward, both / (1 + both)


def lexicon(docs: list[list[bytes]], toxic: list[int]) -> set[bytes]:
    """Words that mark toxic documents: they stand in enough toxic documents, where
    copies of one text count once, and nearly all of their documents are toxic."""
    prints = np.array([fingerprint(b" ".join(words)) for words in docs], np.uint64)
    support: dict[bytes, set[int]] = defaultdict(set)
    clean: dict[bytes, set[int]] = defaultdict(set)
    for k, (words, y) in enumerate(zip(docs, toxic)):
        leader = int(np.argmax(np.bitwise_count(prints ^ prints[k]) <= COPY_BITS))
        for w in set(words):
            (support if y else clean)[w].add(leader)
    groups = len({g for of in support.values() for g in of})
    others = max(1, len({g for of in clean.values() for g in of}))
    need = max(LEAST_SUPPORT, SUPPORT * groups)
    return {w for w, of in support.items() if w and len(of) >= need and len(of) >= PRECISION * (len(of) + groups / others * len(clean[w]))}


def train(texts: list[bytes], toxic: list[int], weight: list[float]) -> Chain:
    """The field and the calibration from a sample; weight undoes the sampling of
    each label."""
    pool: dict[bytes, bytes] = {}  # one object for each word
    docs = [[pool.setdefault(w, w) for w in map(bare, spaced_words(t))] for t in texts]
    marks = lexicon(docs, toxic)
    count: dict[bytes, int] = defaultdict(int)
    for words in docs:
        for w in words:
            count[w] += 1
    chain = Chain(sorted(w for w, n in count.items() if n >= LEAST_TOKENS))
    known: dict[bytes, int] = {}
    table: list[tuple[int, int]] = []
    ids = [chain.ids(words, known, table) for words in docs]
    target = [np.fromiter((bool(y) and w in marks for w in words), bool, len(words)) for words, y in zip(docs, toxic)]
    whole = np.array([len(x) for x in ids], np.int64)
    del docs, count, pool
    flat, y = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, bool), *target])
    if not len(flat):
        return chain
    lookup = np.array(table, np.int64)
    word, stems = lookup[flat, 0], lookup[flat, 1]
    ends = np.cumsum(whole)
    cuts = np.concatenate([np.arange(e - n, e, CHAIN) for e, n in zip(ends.tolist(), whole.tolist()) if n])
    sizes = np.diff(np.append(cuts, len(flat)))
    _ascend(chain, word, stems, y, cuts, sizes)
    local = chain.local(word, stems, ends - whole)
    some = whole > 0
    _, _, p = marginals(local, (ends - whole)[some], whole[some], chain.move)
    _calibrate(chain, summary(p, ends - whole, whole), np.array(toxic, float), np.array(weight))
    return chain


def _ascend(chain: Chain, word: np.ndarray, stems: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Gradient ascent on the log likelihood: observed less expected counts."""
    inside = np.ones(len(word), bool)
    inside[starts] = False  # tokens that have a neighbour before them in their chain
    at = np.flatnonzero(inside)
    yy = y.astype(float)
    seen_moves = np.array([[np.sum(~y[at - 1] & ~y[at]), np.sum(~y[at - 1] & y[at])], [np.sum(y[at - 1] & ~y[at]), np.sum(y[at - 1] & y[at])]], float)
    params = [chain.word, chain.before, chain.after, chain.stem, chain.bias, chain.move]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(word)
    for step in range(1, ROUNDS + 1):
        local = chain.local(word, stems, starts)
        f, b, p = marginals(local, starts, sizes, chain.move)
        error = yy - p
        a, odds = np.exp(chain.move), np.exp(np.clip(local, -30, 30))
        left, right = f[at - 1], odds[at] * b[at]
        pair = [a[0, 1] * right, a[1, 0] * left, a[1, 1] * left * right]
        whole = a[0, 0] + pair[0] + pair[1] + pair[2]
        expected = np.array([np.sum(x / whole) for x in (a[0, 0], *pair)]).reshape(2, 2)
        del left, right, pair, whole, f, b, odds
        grads = [
            np.bincount(word, error, len(chain.word)),
            np.bincount(word[at - 1], error[at], len(chain.word)),
            np.bincount(word[at], error[at - 1], len(chain.word)),
            np.bincount(stems, error, STEMS),
            np.array([error.sum()]),
            seen_moves - expected,
        ]
        for k, (param, g) in enumerate(zip(params, grads)):
            g = (g - PENALTY * param) / n
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            param += STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)


def summary(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document the log of one plus the sum of its marginals that are not
    negligible, so that mere length counts for nothing."""
    out = np.zeros((len(sizes), 1))
    some = np.flatnonzero(sizes > 0)
    if len(some):
        out[some, 0] = np.log1p(np.add.reduceat(np.where(p >= NEGLIGIBLE, p, 0.0), starts[some]))
    return out


def _calibrate(chain: Chain, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the labels on the documents' summaries, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = chain.calibration * 0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * weight.sum() / len(y) * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-3 * weight.sum() / len(y) * w), -4, 4)
    chain.calibration = w


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text") -> Chain:
    """A field fitted on a sample of labelled documents, a bounded number of each
    label and of their bytes, drawn by a hash of the id: documents in the order of the
    hash, as long as SAMPLE_BYTES last, none of more than a sixteenth of them. `training` tells by id which labels may be
    used. Null labels are left out; an id with both labels counts as toxic; a null
    text counts as empty. Without labels of both kinds every score stays low."""
    known = labels.where(training & F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, SAMPLE / n) for y, n in counts.items()}
    pick = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    drawn = known.where(hash_fraction(F.col(id_col)) < pick)
    mark = F.xxhash64(F.lit("sample"), F.col(text))
    sized = docs.select(id_col, mark.alias("mark"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size")).join(F.broadcast(drawn), id_col)
    sized = sized.withColumn("size", F.when(F.col("size") <= SAMPLE_BYTES // 16, F.col("size")))
    upto = Window.partitionBy("toxic").orderBy(hash_fraction(F.col(id_col)), "mark").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.coalesce(F.col("size").isNotNull() & (F.sum("size").over(upto) <= SAMPLE_BYTES), F.lit(False))
    wanted = [tuple(r) for r in sized.select(id_col, "mark", "toxic", fits.alias("fits")).collect()]
    chosen = docs.sparkSession.createDataFrame(sorted({r[:3] for r in wanted if r[3]}), sized.select(id_col, "mark", "toxic").schema)
    rows = docs.select(id_col, text).withColumn("mark", mark).join(F.broadcast(chosen), [id_col, "mark"]).select(F.coalesce(F.col(text), F.lit("")).alias("text"), "toxic").toArrow()
    texts, toxic = as_bytes(rows.column("text").combine_chunks()), rows.column("toxic").to_pylist()
    del rows
    left_out = {y: sum(r[2] == y for r in wanted) / max(1, sum(r[2] == y and r[3] for r in wanted)) for y in share}
    return train(texts, toxic, [left_out[y] / share[y] for y in toxic])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with toxic_score (0 to 1), toxic_predicted (1 if the score is 0.5 or
    more, else 0) and toxic_spans: code point offsets, end exclusive, of tokens
    whose marginal is 0.5 or more, in order. Null and empty texts get the score of
    a text without toxic tokens; repeated rows give repeated results; an empty table
    gives no rows. A text of any length is scored whole."""
    shared = Shared(docs.sparkSession, chain)

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        field = shared.get()
        known: dict[bytes, int] = {}
        table: list[tuple[int, int]] = []
        for (texts,) in batches:
            if len(known) > KNOWN_WORDS:
                known, table = {}, []
            given = as_bytes(texts)
            ids = [field.ids(spaced_words(t), known, table) for t in given]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = np.concatenate([np.zeros(0, np.int64), *ids])
            lookup = np.array(table, np.int64).reshape(-1, 2)
            p = np.zeros(0)
            if len(flat):
                some = sizes > 0
                local = field.local(lookup[flat, 0], lookup[flat, 1], starts)
                _, _, p = marginals(local, starts[some], sizes[some], field.move)
            x = summary(p, starts, sizes)
            z = field.calibration[0] + x @ field.calibration[1:]
            made = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            spans: list[list[dict]] = [[] for _ in given]
            for d in np.unique(np.searchsorted(starts + sizes, np.flatnonzero(p >= 0.5), "right")).tolist():
                own = p[starts[d] : starts[d] + sizes[d]]
                spans[d] = [{"start": m.start(), "end": m.end(), "marginal": q} for m, q in zip(_WORD.finditer(given[d].decode()), own.tolist()) if q >= 0.5]
            yield [pa.array(made), pa.array((made >= 0.5).astype(np.int32)), pa.array(spans, _ARROW_SPANS)]

    fields = [T.StructField(prefix + "toxic_score", T.DoubleType()), T.StructField(prefix + "toxic_predicted", T.IntegerType()), T.StructField(prefix + "toxic_spans", SPANS)]
    return add_columns(docs, fields, [text], run, SCORED_BYTES)


def remove_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs less those predicted toxic; columns as they were."""
    return with_columns_of(score(docs, chain, "text", "__tox_").where("__tox_toxic_predicted = 0"), docs)
