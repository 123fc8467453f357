"""SentencePiece encoding and decoding without the library.

An Aho-Corasick automaton over all pieces reads a stretch of text once. At each
position it follows the output links, so every piece that ends there is seen, and
each relaxes the best score of the position (Viterbi). Pieces of a unigram model
compete by the sum of their scores. In a BPE model a score only ranks merges, so a
piece may follow another only where merging the two together leaves them as they
are; the one path through such neighbours is what merging gives, and it is found by
the same pass. Characters that no piece covers become byte pieces.

Texts are cut before runs of blanks, which no piece of such models crosses, and
tasks keep the ids of cut stretches that come again.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweave.llm.common import Shared, add_columns

#: The model file that queries use where no other path is given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stretches and neighbours that a task remembers before it starts afresh, and the
#: longest stretch it remembers.
REMEMBERED = 600_000
LONGEST = 48

# Fixed values of the model file format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, dummy_prefix: bool = True) -> None:
        self.pieces, self.scores, self.kinds = pieces, scores, kinds
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        crossing = [p for p, k in zip(pieces, kinds) if k in (NORMAL, USER_DEFINED) and BLANK in p.lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces that cross blanks are not supported: {crossing[:3]}")
        if {k for k in kinds if k == BYTE} and sum(k == BYTE for k in kinds) != 256:
            raise ValueError("a model has either all byte pieces or none")
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.made_of: dict[int, tuple[int, int]] | None = None

    def halves(self) -> dict[int, tuple[int, int]]:
        """For each piece of a BPE model that merging makes from its characters, the
        two pieces of the last merge."""
        if self.made_of is None:
            self.made_of = {}
            ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED)} if self.bpe else {}
            for piece, i in ids.items():
                parts, halves = merge(piece, ids, self.scores)
                if len(parts) == 1 and halves:
                    self.made_of[i] = (ids.get(halves[0], self.unknown), ids.get(halves[1], self.unknown))
        return self.made_of

    @classmethod
    def read(cls, path: str) -> Model:
        """The model in this file, which the driver can open."""
        with open(path, "rb") as file:
            data = file.read()
        pieces, scores, kinds, kind, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("a model that rewrites its text is not supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, scores, kinds, kind == BPE, prefix)


def merge(text: str, ids: dict[str, int], scores: list[float]) -> tuple[list[str], tuple[str, str] | None]:
    """The text's characters after all merges, best score first and then leftmost,
    and the two parts of the last merge."""
    parts, halves = list(text), None
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = ids.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            break
        halves = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, halves


class Encoder:
    """Encodes texts; made once in each task."""

    def __init__(self, model: Model) -> None:
        self.model, self.scores, self.halves = model, model.scores, model.halves()
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER_DEFINED)}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.low = min(model.scores, default=0.0) - 10.0  # of a character that no piece covers
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if not model.bpe or len(piece) == 1 or i in self.halves:  # a piece that merging never makes has no place
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        lines = r"\n" if not any("\n" in p for p in self.ids) else ""
        self.cut = re.compile(rf" *[^ {lines}]+| +" + ("|\\n" if lines else ""))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves the two pieces as they are, side by side. The
        merges that made them are undone from the last one backwards; at each step
        a merge across the border must not have come before the one undone. Equal
        ranks go from left to right, so across the border comes before the right
        piece's merge and after the left one's."""
        ids, scores, pieces, halves = self.ids, self.scores, self.model.pieces, self.halves
        limit, even = None, True
        while True:
            over = ids.get(pieces[a] + pieces[b])
            if over is not None and (limit is None or scores[over] > limit or even and scores[over] == limit):
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and scores[a] < scores[b]:
                limit, even, a = scores[a], False, left[1]
            else:
                limit, even, b = scores[b], True, right[0]

    def _by_neighbours(self, text: str) -> list[int] | None:
        """The path of a BPE model through known characters. Each piece that ends at a
        position relaxes the position's best sum of scores, if it may follow the last
        piece of the best path to where it begins."""
        total: list[float | None] = [0.0] + [None] * len(text)
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        pairs, scores, count = self.pairs, self.scores, len(self.scores)
        for at, (i, length) in self.automaton.iter(text):
            end = at + 1
            start = end - length
            so_far = total[start]
            if so_far is None:
                continue
            if start:
                key = last[start] * count + i
                good = pairs.get(key)
                if good is None:
                    if len(pairs) > REMEMBERED:
                        pairs.clear()
                    good = pairs[key] = self.neighbours(last[start], i)
                if not good:
                    continue
            score = so_far + scores[i]
            if total[end] is None or score > total[end]:
                total[end], last[end], size[end] = score, i, length
        back, end = [], len(text)
        while end:
            if last[end] < 0:
                return None
            back.append(last[end])
            end -= size[end]
        return back[::-1]

    def _by_scores(self, text: str) -> list[int]:
        """The path of a unigram model with the largest sum of scores."""
        n = len(text)
        total: list[float | None] = [0.0] + [None] * n
        last, size, done = [-1] * (n + 1), [0] * (n + 1), 0

        def fill(upto: int) -> None:  # characters that no piece ends with
            for end in range(done + 1, upto + 1):
                if total[end] is None:
                    total[end], size[end] = total[end - 1] + self.low, 1

        for at, (i, length) in self.automaton.iter(text):
            if at > done:
                fill(at)
                done = at
            score = total[at + 1 - length] + self.scores[i]
            if total[at + 1] is None or score > total[at + 1]:
                total[at + 1], last[at + 1], size[at + 1] = score, i, length
        fill(n)
        back, end = [], n
        while end:
            back.append([last[end]] if last[end] >= 0 else self.as_bytes(text[end - 1]))
            end -= size[end]
        return [i for part in reversed(back) for i in part]

    def best(self, text: str) -> list[int]:
        """Ids of the best path through a stretch in which ' ' stands as BLANK."""
        if not self.model.bpe:
            return self._by_scores(text)
        if self.chars.issuperset(text):
            return self._known(text)
        out: list[int] = []
        for known, part in groupby(text, self.chars.__contains__):
            part = "".join(part)
            if known:
                out += self._known(part)
            else:
                out += [i for char in part for i in self.as_bytes(char)]
        return out

    def _known(self, text: str) -> list[int]:
        path = self._by_neighbours(text)
        return [self.ids[p] for p in merge(text, self.ids, self.scores)[0]] if path is None else path

    def as_bytes(self, char: str) -> list[int]:
        """Byte pieces of a character that no piece covers."""
        return [self.model.byte_ids.get(b, self.model.unknown) for b in char.encode()] if self.model.byte_ids else [self.model.unknown]

    def stretch(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is None:
            found = array("i", self.best(text.replace(" ", BLANK))).tobytes()
            if len(text) <= LONGEST:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. A BLANK that the text itself holds becomes byte pieces,
        so that decoding gives it back."""
        if not text:
            return np.zeros(0, np.int32)
        first, *rest = text.split(BLANK)
        made = [b"".join(map(self.stretch, self.cut.findall((" " if self.model.dummy_prefix else "") + first)))]
        for part in rest:
            made += [np.array(self.as_bytes(BLANK), np.int32).tobytes(), *map(self.stretch, self.cut.findall(part))]
        return np.frombuffer(b"".join(made), np.int32)


class Decoder:
    """Texts from ids; ids outside the vocabulary are left out."""

    def __init__(self, model: Model) -> None:
        made = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), USER_DEFINED: lambda p: p.replace(BLANK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.bytes = [made.get(k, lambda p: b"")(p) for p, k in zip(model.pieces, model.kinds)]
        self.dummy_prefix = model.dummy_prefix

    def decode(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.bytes))].tolist()
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _id_lists(made: list[np.ndarray | None]) -> pa.ListArray:
    sizes = np.array([0, *(0 if m is None else len(m) for m in made)], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *(m for m in made if m is not None)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([m is None for m in made], pa.bool_()))


def encode(docs: DataFrame, model: Model, text: str = "text", name: str = "piece_ids", check: bool = False) -> DataFrame:
    """docs with an array of piece ids. A null text gives null, an empty one no ids;
    repeated texts give equal ids. With `check` the ids are decoded again where they
    were made: decoded_sha256 is the decoded text's hash and round_trip tells whether
    it is the text; both are null for a null text."""
    model.halves()
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        encoder, decoder = Encoder(shared.get()), Decoder(shared.get())
        for (texts,) in batches:
            given = texts.to_pylist()
            made = [None if t is None else encoder.encode(t) for t in given]
            out = [_id_lists(made)]
            if check:
                back = [None if m is None else decoder.decode(m) for m in made]
                out.append(pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()))
                out.append(pa.array([None if t is None else t == b for t, b in zip(given, back)], pa.bool_()))
            yield out

    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))]
    if check:
        fields += [T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    return add_columns(docs, fields, [text], run, 2_000_000)


def decode(docs: DataFrame, model: Model, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """docs with the text of an array of piece ids; null ids give null, no ids an
    empty text, and null or unknown ids within an array are left out."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        decoder = Decoder(shared.get())
        for (arrays,) in batches:
            arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
            offsets, flat = arrays.offsets.to_numpy(), arrays.values.fill_null(-1).to_numpy()
            valid = arrays.is_valid().to_pylist()
            yield [pa.array([decoder.decode(flat[a:b]) if v else None for a, b, v in zip(offsets, offsets[1:], valid)], pa.string())]

    return add_columns(docs, [T.StructField(name, T.StringType())], [ids], run, 8_000_000)
