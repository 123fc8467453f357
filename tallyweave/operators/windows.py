"""The program of J25 over slices of documents: anchors against windows of lines.

A document's texts are one row of code points each side. A text's distinct characters are
a row of bits, a window's those of its lines together, so that common characters are
counted exactly and no window's text is ever made. Which windows hold an anchor follows
from where it stands in the document's whole text; which are held by one is looked up for
those alone whose characters it has and that may still win.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from tallyweave.functions.text import POINTS, comparison_points

# The program travels to the executors by value, as those of the training-data operators
# do: a cluster needs numpy and Arrow there, but not this package.
cloudpickle.register_pickle_by_value(sys.modules["tallyweave"])

#: Bytes of text that are dealt with at once, at least one document; a row counts as so many more.
SLICE, ROW = 2_000_000, 64
#: Pairs of an anchor and a line that are dealt with at once, at least those of one anchor.
PAIRS = 1 << 17
#: Bytes of a block of flags, one for each text and character.
FLAGS = 1 << 24
#: Up to so many words of bits all pairs are counted, beyond it those alone that one word leaves.
FEW = 4
#: A rounded score is a whole number of millionths; no anchor stands in lines from FAR on.
MILLION, FAR = 1_000_000, 1 << 40


@dataclass
class _Texts:
    """Texts that are not blank, one after the other: which rows they are, where each
    document's begin, the characters and where each text's begin."""

    rows: np.ndarray
    docs: np.ndarray
    points: np.ndarray
    at: np.ndarray
    text: str


def _folded(texts: pa.Array, docs: np.ndarray, table: np.ndarray) -> _Texts:
    plain = texts.to_pylist()
    points = table[np.frombuffer("".join(plain).encode("utf-32-le"), "<u4")]
    kept = points >= 0
    before = np.concatenate([[0], np.cumsum(kept)])
    at = before[np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])]
    full = at[1:] > at[:-1]
    points = points[kept]
    rows = np.flatnonzero(full)
    return _Texts(rows, np.concatenate([[0], np.cumsum(full)])[docs], points, at[np.append(rows, len(full))], points.astype("<u4").tobytes().decode("utf-32-le"))


@dataclass
class _Chars:
    """Of texts or windows the distinct characters: rows of bits, how many, and all words
    of a row in one."""

    bits: np.ndarray

    def __post_init__(self) -> None:
        self.n = np.bitwise_count(self.bits).sum(1, dtype=np.int32)
        self.folded = np.bitwise_or.reduce(self.bits, 1)


def _bits(places: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """A row of bits for each text, of which bit k tells that it has character k."""
    out, size = np.zeros((len(at) - 1, words), np.uint64), 64 * words
    step = max(1, FLAGS // size)
    for k in range(0, len(out), step):
        own = at[k : k + step + 1]
        has = np.zeros((len(own) - 1) * size, bool)
        has[np.repeat(np.arange(0, len(has), size), np.diff(own)) + places[own[0] : own[-1]]] = True
        out[k : k + step] = np.packbits(has, bitorder="little").view("<u8").reshape(-1, words)
    return out


def _spans(bits: np.ndarray, width: int) -> _Chars:
    """Of all runs of `width` rows the bits that any of them has."""
    n = 1
    while 2 * n <= width:
        bits, n = bits[:-n] | bits[n:], 2 * n
    return _Chars(bits[: n - width] | bits[width - n :] if n < width else bits)


def _millionths(score: np.ndarray) -> np.ndarray:
    """Scores as DuckDB's round(score, 6) has them."""
    scaled = score * MILLION
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)).astype(np.int64)


def _ends(anchor: str, lines: str, at: list[int], first: int, last: int) -> tuple[list[int], list[int]]:
    """For runs of a document's lines the line where the anchor ends that begins in them
    or after them, first of all: how many lines, and that line."""
    counts, ends = [], []
    while first < last and (found := lines.find(anchor, at[first], at[last])) >= 0:
        begins = bisect_right(at, found, first, last) - 1
        counts.append(begins + 1 - first)
        ends.append(bisect_right(at, found + len(anchor) - 1, begins, last) - 1)
        first = begins + 1
    return [*counts, last - first], [*ends, FAR]


def _slice(a: _Texts, k: np.ndarray, l: _Texts, least: float) -> tuple[np.ndarray, ...]:
    """Of each anchor that has a window: its place among a, the score, the window's first
    line among l and how many lines it has."""
    seen = np.zeros(POINTS, bool)
    seen[a.points] = seen[l.points] = True
    known = np.flatnonzero(seen)
    place = np.zeros(POINTS, np.int32)
    place[known] = np.arange(len(known))
    words = max(1, -(-len(known) // 64))
    own, lines = _Chars(_bits(place[a.points], a.at, words)), _bits(place[l.points], l.at, words)
    doc = np.repeat(np.arange(len(a.docs) - 1), np.diff(a.docs))
    first, last = l.docs[doc], l.docs[doc + 1]
    fits, at, out = (k > -2) & (last - first >= np.maximum(k, 1)), l.at.tolist(), []
    for n in np.unique(k[fits]).tolist():
        windows = {w: _spans(lines, w) for w in range(max(n, 1), min(n + 2, len(lines)) + 1)}
        these, begin = np.flatnonzero(fits & (k == n)), 0
        upto = np.cumsum((last - first)[these])
        while begin < len(these):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
            chunk, begin = these[begin:end], end
            best = _best(a, l, at, chunk, first[chunk], last[chunk], own, windows, n, least)
            won = np.flatnonzero(best >= 0)
            score, start, short = best[won] >> 42, FAR - 1 - (best[won] >> 2 & (FAR - 1)), best[won] & 3
            out.append((chunk[won], score, start, n + 2 - short))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out) if out else [()] * 4))


def _best(a: _Texts, l: _Texts, at: list[int], chunk: np.ndarray, first: np.ndarray, last: np.ndarray, own: _Chars, windows: dict[int, _Chars], n: int, least: float) -> np.ndarray:
    """The best window of each anchor of a chunk as one number, of score, first line
    (less is better) and width (less is better), or -1."""
    many = last - first
    heads = np.cumsum(many) - many
    turn = np.repeat(np.arange(len(chunk)), many)
    line = np.arange(len(turn)) + np.repeat(first - heads, many)
    counts, ends = [], []
    for i, x, y in zip(chunk.tolist(), first.tolist(), last.tolist()):
        told = _ends(a.text[a.at[i] : a.at[i + 1]], l.text, at, x, y)
        counts += told[0]
        ends += told[1]
    reach = np.repeat(np.array(ends), np.array(counts)) - line + 1
    room = np.repeat(last, many) - line
    row, size, words, held = chunk[turn], np.diff(a.at), own.bits.shape[1], []
    best = np.full(len(turn), -1)
    for width, have in windows.items():
        p = np.flatnonzero(room >= width)
        if words > FEW:
            p = p[_near(own, have, row[p], line[p], least) | (reach[p] <= width)]
        i, s = row[p], line[p]
        common = sum(np.bitwise_count(own.bits[i, w] & have.bits[s, w]).astype(np.int32) for w in range(words))
        na, nw = own.n[i], have.n[s]
        la, lw = size[i], l.at[s + width] - l.at[s]
        score = _millionths(common / (na + nw - common))
        holds = reach[p] <= width
        maybe = (common == nw) & (lw <= la) & ~holds
        some = np.flatnonzero(holds | maybe)
        within = np.zeros(len(p), np.int64)
        within[some] = _millionths(0.85 + 0.15 * np.minimum(la, lw)[some] / np.maximum(la, lw)[some])
        score[holds] = within[holds]
        number = (score << 42) | (FAR - 1 - s << 2) | (n + 2 - width)
        good = (score / MILLION >= least) & ~maybe
        best[p[good]] = np.maximum(best[p[good]], number[good])
        m = np.flatnonzero(maybe)
        held.append((p[m], number[m], (within[m] << 42) | (number[m] & ((1 << 42) - 1)), s[m], s[m] + width))
    top = np.maximum.reduceat(best, heads)
    p, apart, inside, s, e = (np.concatenate(x) for x in zip(*held))
    may = np.maximum(apart, inside)
    p, apart, inside, s, e, may = (x[(may > top[turn[p]]) & (may >> 42 >= np.floor(least * MILLION))] for x in (p, apart, inside, s, e, may))
    order = np.lexsort((-may, turn[p]))
    leader = top.tolist()
    for i, x, y, begin, end, most in zip(*(z[order].tolist() for z in (turn[p], apart, inside, s, e, may))):
        if most > leader[i]:
            c = int(chunk[i])
            value = y if a.text.find(l.text[at[begin] : at[end]], a.at[c], a.at[c + 1]) >= 0 else x
            if value > leader[i] and (value >> 42) / MILLION >= least:
                leader[i] = value
    return np.array(leader)


def _near(own: _Chars, have: _Chars, i: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    """Whether one word leaves a pair: a bit that one side alone has stands for one
    character or more that the other lacks. Scores may be rounded up to `least`."""
    x, y, n, m = own.folded[i], have.folded[s], own.n[i].astype(np.int64), have.n[s].astype(np.int64)
    lone, other = np.bitwise_count(x & ~y), np.bitwise_count(y & ~x)
    return ((1 + least) * np.minimum(n - lone, m - other) >= (least - 1e-5) * (n + m)) | (other == 0)


def best_windows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, anchor, line_no, width, score) of documents (doc_id, a, l): lists of
    anchors (anchor, k, text) and of lines (line_no, text) in order."""
    table = comparison_points()
    for batch in batches:
        parts = np.cumsum(sum(_weights(x) for x in batch.columns[1:])) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin < end:
                yield _rows(*batch.slice(begin, end - begin).columns, table, schema, least)


def _bounds(lists: pa.ListArray) -> np.ndarray:
    bounds = np.asarray(lists.offsets)
    return bounds - bounds[0]


def _weights(lists: pa.ListArray) -> np.ndarray:
    sizes = pc.binary_length(lists.flatten().field("text")).to_numpy(zero_copy_only=False).astype(np.int64) + ROW
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[_bounds(lists)])


def _rows(doc_id: pa.Array, a: pa.ListArray, l: pa.ListArray, table: np.ndarray, schema: pa.Schema, least: float) -> pa.RecordBatch:
    bounds = _bounds(a)
    anchors, lines = a.flatten(), l.flatten()
    left, right = _folded(anchors.field("text"), bounds, table), _folded(lines.field("text"), _bounds(l), table)
    k = anchors.field("k").to_numpy(zero_copy_only=False).astype(np.int64)[left.rows]
    won, score, start, width = _slice(left, k, right, least)
    row = left.rows[won]
    doc = np.searchsorted(bounds, row, "right") - 1
    # Rows that share an anchor's number have one window together.
    name = anchors.field("anchor").take(pa.array(row)).dictionary_encode("encode").indices.to_numpy()
    order = np.lexsort((width, start, -score, name, doc))
    doc, row, score, start, width, name = (x[order] for x in (doc, row, score, start, width, name))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    doc, row, score, start, width = (x[new] for x in (doc, row, score, start, width))
    made = [doc_id.take(pa.array(doc)), anchors.field("anchor").take(pa.array(row)), lines.field("line_no").take(pa.array(right.rows[start])), pa.array(width), pa.array(score / MILLION)]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema)], schema=schema)
