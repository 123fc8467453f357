"""Language identification by compression.

For each language a bounded sample of training text becomes a raw-content zstandard
dictionary. A text is cut into blocks, every block is compressed with every
dictionary, and the language whose dictionary gives the fewest bytes in all wins.
Narrow margins are marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import add_columns, hash_fraction

#: Bytes of each dictionary; training documents of a language that it is cut from, at
#: most about; pieces that each of them gives, and characters of a piece at most.
DICTIONARY_BYTES = 110_000
DOCUMENTS = 240
PIECES, PIECE = 4, 250
#: Bytes that are compressed at once: small enough that the dictionary counts throughout.
BLOCK = 4096
LEVEL = 6
#: Dictionaries that a task holds ready at a time.
READY = 32
#: A margin under this share of the runner-up's bytes is narrow.
NARROW = 0.005
#: A margin of this share gives a score of about two thirds.
USUAL = 0.05
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, with one blank for each run of other characters."""
    return _REST.sub(" ", text.lower()).encode()


def pieces(text: Column) -> Column:
    """One piece of each quarter of a text, from a place that the text's hash draws."""
    quarter = F.greatest(F.ceil(F.length(text) / PIECES), F.lit(1)).cast("int")
    size = F.least(quarter, F.lit(PIECE))
    start = lambda k: F.lit(k) * quarter + F.pmod(F.xxhash64(text, F.lit(k)), quarter - size + 1).cast("int") + 1
    return F.array(*[F.substring(text, start(k), size) for k in range(PIECES)])


def level(sizes: list[int], most: int) -> int:
    """The largest share up to which each may be taken so that all stay within most."""
    left = most
    for k, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - k) > left:
            return left // (len(ordered) - k)
        left -= size
    return max(sizes, default=0)


def fill(documents: list[tuple[str, ...]]) -> bytes:
    """A dictionary's content: equal shares of bytes of all documents and of all
    pieces of each; what short ones leave goes to the others."""
    parts = [[letters(p) for p in d] for d in documents]
    share = level([sum(map(len, d)) + len(d) for d in parts], DICTIONARY_BYTES)
    most = [level(list(map(len, d)), max(0, share - len(d))) for d in parts]
    return b" ".join(p[:m] for d, m in zip(parts, most) for p in d)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary's content for each language of the training rows, rows with a
    null text or language left out. A hash of the id draws a bounded number of
    documents of each language, which stand in the order of their pieces' hashes;
    equal ones count once. Languages come in the order of their training rows,
    most first."""
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()
    made: dict[str, bytes] = {}
    if not counts:
        return made
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, DOCUMENTS / r[1]))])
    drawn = rows.where(hash_fraction(F.col(id_col)) < F.element_at(share, F.col(lang)))
    parts: dict[str, set[tuple]] = {}
    for name, found, drawn_at in drawn.select(F.col(lang), pieces(F.col(text)).alias("p")).select(lang, "p", F.xxhash64("p")).collect():
        parts.setdefault(name, set()).add((drawn_at, *found))
    for name, *_ in counts:
        made[name] = fill([d[1:] for d in sorted(parts.get(name, ()))])
    return {k: v.ljust(8) for k, v in made.items()}  # zstandard takes no shorter one


def compressors(group: list[bytes]) -> list[zstandard.ZstdCompressor]:
    """One for each raw-content dictionary."""
    made = []
    for raw in group:
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False))
    return made


def sizes(text: str, coders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of a whole text, block by block, under each dictionary."""
    data = letters(text)
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in coders], np.int64)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1, from the margin over the runner-up)
    and lang_rejected (narrow margin). A null text, a text without a letter, and
    any text when nothing was learned give 'und', score 0, rejected. Of languages
    with equal sizes the first in the dictionaries' order wins, rejected. Repeated
    rows give repeated results; an empty table gives no rows. With more than READY
    languages a task builds the dictionaries anew for each slice of texts, so that its
    memory does not grow with their number."""
    names = list(dictionaries)
    groups = [[dictionaries[n] for n in names[at : at + READY]] for at in range(0, len(names), READY)]

    def run(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        ready = compressors(groups[0]) if len(groups) == 1 else None
        for (texts,) in batches:
            given = texts.to_pylist()
            able = [k for k, t in enumerate(given) if t is not None and names and _LETTER.search(t)]
            found = np.zeros((len(able), len(names)), np.int64)
            at = 0
            for group in groups:
                coders = ready or compressors(group)
                for row, k in enumerate(able):
                    found[row, at : at + len(group)] = sizes(given[k], coders)
                at += len(group)
            made = [(UNDETERMINED, 0.0, True)] * len(given)
            for size, k in zip(found, able):
                best = int(size.argmin())
                rest = np.delete(size, best)
                margin = float((rest.min() - size[best]) / max(1, rest.min())) if len(rest) else 1.0
                made[k] = (names[best], 1.0 - float(np.exp(-margin / USUAL)), margin < NARROW)
            yield [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())]

    fields = [T.StructField(prefix + "lang_pred", T.StringType()), T.StructField(prefix + "lang_score", T.DoubleType()), T.StructField(prefix + "lang_rejected", T.BooleanType())]
    return add_columns(docs, fields, [text], run)
