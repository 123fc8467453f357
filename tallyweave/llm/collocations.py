"""Phrase collocations from depth-truncated suffix subtrees, partitioned by prefixes.

A first pass over the texts counts words, and pairs of neighbouring words by a hash of
both. A phrase cannot be more frequent than any pair in it, so a suffix is cut off at
its first pair that is too rare, at four words at most. A second pass deals these
suffixes out by their first words: prefixes are bundled, and bundles are grouped up to a
budget of suffixes; the bundles of a prefix that is over the budget alone are extended
by the second word. Each group builds its own subtree: the sorted distinct suffixes are
its leaves, and the leaf totals below a node are the occurrences of the node's phrase.
Everything is counted per language; a word's hash is seeded with its language.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import Batches, as_bytes, bit_filter, column, in_filter, materialize

MOST_WORDS, LEAST, TOP = 4, 30, 2000
#: Per cent of a phrase's occurrences in a longer candidate at which it is dropped.
COVERED = 80
#: Bytes of text that a task combines before it shuffles.
SLICE_BYTES = 6_000_000
#: Bytes of text whose words and pairs one bucket of the first pass counts, about.
BUCKET_BYTES, LEAST_BUCKETS = 16_000_000, 16
#: The memory budget of a group: occurrences of its prefixes. Prefixes are dealt into
#: so many bundles by their hash.
GROUP_SUFFIXES, BUNDLES = 4_000_000, 4096
#: Bits of the filter of frequent pairs. A filter that is too small costs work, as more
#: suffixes pass it; the counts stay the same.
FILTER_BITS = 1 << 26

#: A byte that UTF-8 text does not hold stands for an end of a piece.
_END = b"\xff"
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of these texts, and the number of each word in its order; number 0
    stands for an end of a piece."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    number[_END]
    tokens = (_END.join(texts) + _END).translate(_TABLE).replace(_END, b" \xff ").split()
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    return list(number), ids


def _hashes(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """A hash other than 0 of each word but the end of a piece, which has 0."""
    own, mix = xxhash.xxh64_intdigest(lang.encode(), seed), xxhash.xxh64_intdigest
    out = np.array([mix(w, own) for w in words], np.uint64) | np.uint64(1)
    out[0] = 0
    return out


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + (b >> np.uint64(29)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return key ^ (key >> np.uint64(32))


def _slices(batches: Batches) -> Iterator[tuple[str, list[bytes]]]:
    """Each language's texts of about SLICE_BYTES of input."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs and the places where it does."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(bucket[at[0]]), at


_PACKED = "kind int, lang string, bucket bigint, keys binary, counts binary, words binary"
_COUNTED = "kind int, lang string, key bigint, n bigint, word string, clash boolean"
_TOTAL, _WORD, _PAIR = 0, 1, 2


def _count(docs: DataFrame, buckets: int, least: int, seed: int) -> DataFrame:
    """Words and hashed pairs of `least` occurrences or more, and each language's
    number of words. `clash` marks words of one hash."""

    def pack(batches: Batches) -> Batches:
        for lang, texts in _slices(batches):
            words, ids = pieces_of(texts)
            key = _hashes(words, lang, seed)
            n = np.bincount(ids, minlength=len(words))[1:]
            out: list[tuple] = []
            for b, at in _dealt((key[1:] % np.uint64(buckets)).astype(np.int64)):
                out.append((_WORD, lang, b, key[1:][at].tobytes(), n[at].astype(np.uint32).tobytes(), b" ".join([words[i + 1] for i in at.tolist()])))
            del words
            a, b = ids[:-1], ids[1:]
            inside = (a > 0) & (b > 0)
            own, n = np.unique(a[inside] * len(key) + b[inside], return_counts=True)
            pair = _pair_key(key[own // len(key)], key[own % len(key)])
            for b, at in _dealt((pair % np.uint64(buckets)).astype(np.int64)):
                out.append((_PAIR, None, b, pair[at].tobytes(), n[at].astype(np.uint32).tobytes(), b""))
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), kinds)], names=names)

    def fold(table: pa.Table) -> pa.Table:
        kind, lang = table.column("kind")[0].as_py(), table.column("lang")[0].as_py()
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        own, first, at = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, n)
        often = total >= least
        word: list[str | None] = [None] * int(often.sum())
        clash = False
        if kind == _WORD:
            words = b" ".join(table.column("words").to_pylist()).split(b" ")
            word = [words[i].decode() for i in first[often].tolist()]
            seen = np.flatnonzero(often[at])
            clash = any(words[i] != words[j] for i, j in zip(seen.tolist(), first[at[seen]].tolist()))
        rows = [(kind, lang, int(k), int(c), w, False) for k, c, w in zip(own[often].view(np.int64), total[often], word)]
        if kind == _WORD:
            rows.append((_TOTAL, lang, None, int(total.sum()), None, clash))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(made)], names=["kind", "lang", "key", "n", "word", "clash"])

    names = ["kind", "lang", "bucket", "keys", "counts", "words"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    made = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return materialize(docs.mapInArrow(pack, _PACKED).groupBy("kind", "lang", "bucket").applyInArrow(fold, _COUNTED))


def grouped(weights: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each bundle, and over how many groups its second words
    spread it: neighbouring bundles share a group while they keep to the budget."""
    first, parts, at, held = np.zeros(len(weights), np.int64), np.ones(len(weights), np.int64), 0, 0
    for k, w in enumerate(weights.tolist()):
        if held and held + w > budget:
            at, held = at + 1, 0
        first[k], held = at, held + w
        if w > budget:
            parts[k] = -(-w // budget)
            at, held = at + int(parts[k]), 0
    return first, parts


def _suffixes(docs: DataFrame, counted: DataFrame, seed: int) -> DataFrame:
    """The distinct suffixes of each slice, packed by language and group."""
    frequent = counted.where(F.col("kind") == _WORD)
    told = frequent.groupBy(F.shiftrightunsigned("key", 52).alias("bundle")).agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(BUNDLES, np.int64)
    weights[told.column("bundle").to_numpy()] = told.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((bit_filter(counted.where(F.col("kind") == _PAIR), "key", FILTER_BITS), *grouped(weights, GROUP_SUFFIXES)))

    def pack(batches: Batches) -> Batches:
        bits, first, parts = shared.value
        for lang, texts in _slices(batches):
            words, ids = pieces_of(texts)
            key = _hashes(words, lang, seed)
            v = len(words)
            del words
            # A pair is numbered where it stands inside a piece and may be frequent.
            pair = ids[:-1] * v + ids[1:]
            own, at = np.unique(np.where((ids[:-1] > 0) & (ids[1:] > 0), pair, 0), return_inverse=True)
            good = (own > 0) & in_filter(bits, _pair_key(key[own // v], key[own % v]))
            stands = np.concatenate([good[at], np.zeros(MOST_WORDS, bool)])
            p = len(own)
            where = np.flatnonzero(stands)
            if not len(where):
                continue
            three = stands[where + 1]
            four = three & stands[where + 2]
            ids, at = np.concatenate([ids, np.zeros(MOST_WORDS, np.int64)]), np.concatenate([at, np.zeros(MOST_WORDS, np.int64)])
            # Pair number and what follows: nothing, a word, or a pair. All are exact numbers.
            after = np.where(four, 1 + v + at[where + 2], np.where(three, 1 + ids[where + 2], 0))
            code, n = np.unique(at[where] * (1 + v + p) + after, return_counts=True)
            begin, after = own[code // (1 + v + p)], code % (1 + v + p)
            pairs = np.where(after > v, own[np.maximum(after - 1 - v, 0)], 0)
            third = np.where(after > v, pairs // v, np.where(after > 0, after - 1, 0))
            rows = np.stack([key[begin // v], key[begin % v], key[third], key[pairs % v]], axis=1)
            bundle = (rows[:, 0] >> np.uint64(52)).astype(np.int64)
            group = first[bundle] + ((rows[:, 1] >> np.uint64(24)).astype(np.int64) % parts[bundle])
            out = [(lang, g, rows[i].tobytes(), n[i].astype(np.uint32).tobytes()) for g, i in _dealt(group)]
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), kinds)], names=["lang", "part", "rows", "counts"])

    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
    return docs.mapInArrow(pack, "lang string, part bigint, rows binary, counts binary")


def subtree(rows: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Paths of two words and more with `least` occurrences or more, and these, depth by
    depth. Rows are suffixes, cut off ones filled up with 0; n says how often each stands."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    differs = np.ones(rows.shape, bool)
    differs[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    out = []
    for depth in range(2, rows.shape[1] + 1):
        start = np.flatnonzero(differs[:, depth - 1])
        total = np.add.reduceat(n, start)
        keep = (rows[start, depth - 1] > 0) & (total >= least)
        out.append((rows[start[keep], :depth], total[keep]))
    return out


def _candidates(docs: DataFrame, counted: DataFrame, least: int, seed: int) -> DataFrame:
    """(lang, words, a) of every phrase of two words and more that is frequent."""

    def build(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint64).reshape(-1, MOST_WORDS)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
        found = subtree(rows, n, least)
        words = [r for paths, _ in found for r in paths.view(np.int64).tolist()]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(words), pa.string()), "words": pa.array(words, pa.list_(pa.int64())), "a": pa.array(np.concatenate([t for _, t in found]), pa.int64())})

    packed = _suffixes(docs, counted, seed)
    return materialize(packed.groupBy("lang", "part").applyInArrow(build, "lang string, words array<bigint>, a bigint"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of
    two to four words that stand within pieces `least` times or more.

    l and r are the occurrences of the two parts at the cut of the lowest score
    floor(2000000 * a / (l + r)), the first such cut. A phrase inside a longer candidate
    that has `covered` per cent or more of its occurrences is left out. A null text counts
    as empty, a null language as `und`; repeated rows count each time; of phrases equal
    in score and a the one of smaller bytes comes first; a table without words gives no
    rows. Other columns, whatever their names, are not read."""
    docs = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    for seed in count():
        counted = _count(docs, buckets, least, seed)
        if counted.where("clash").isEmpty():
            break
    words = counted.where(F.col("kind") == _WORD).select("lang", "key", F.col("n").alias("f"), "word")
    totals = counted.where(F.col("kind") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    found = _candidates(docs, counted, least, seed)
    known = words.select("lang", F.array("key").alias("words"), "f").union(found)

    # Each candidate's parts at each cut; both are as frequent as it is, and so are known.
    cuts = found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("words").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(19,0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))))
    within = found.where(F.size("words") > 2).select("lang", F.explode(spans).alias("words"), F.col("a").alias("longer"))
    dropped = within.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = scored.join(dropped, ["lang", "words"], "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(19,0)) < {covered} * cast(a as decimal(19,0))")).drop("longer")

    # Words are joined to those that may be listed; ties at the end come along.
    order = [F.desc("score"), F.desc("a")]
    listed = materialize(kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place"))
    named = listed.select("*", F.posexplode("words").alias("at", "key")).join(words.drop("f"), ["lang", "key"])
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    spelled = named.groupBy("lang", "words", "a", "l", "r", "score").agg(phrase).join(totals, "lang")
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
