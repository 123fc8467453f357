"""Helpers that the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local
    folder is set only where the session names none and runs in one process, as in
    tests; on a cluster no folder of the driver's own would do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared folder, so that a lost
    executor costs a reread and not the work behind it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into a new folder that all executors share, and reread."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def place_of(df: DataFrame, name: str) -> int:
    """The place of the column of this name; case decides where only it differs."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return same[0]


def with_columns_of(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of df that `like` has, in its order."""
    return df.select(*[column(c) for c in like.columns])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns of these names in any case: an operator's own columns
    replace columns of the same name that the input happened to have."""
    gone = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in gone])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; an id of null is
    never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def hash_fraction(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone, to draw the
    same bounded sample in every run."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    inputs: list[str],
    function: Callable[[Iterator[list[pa.Array]]], Iterator[list[pa.Array]]],
    slice_bytes: int = 4_000_000,
) -> DataFrame:
    """df with further columns that `function` works out, one list of arrays for
    each list of input arrays or several, for the next rows of it each. Existing columns
    of the new names are replaced, whatever other columns are called. The rows come in
    slices of about `slice_bytes` of input, whole rows each."""
    # Inside, columns are named by their places, so that any names will do.
    names = [f"__c{k}" for k in range(len(df.columns))]
    gone = {f.name.lower() for f in fields}
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in gone]
    work = df.toDF(*names).select(*[names[k] for k in kept], *[F.col(names[place_of(df, c)]).alias(f"__in{i}") for i, c in enumerate(inputs)])
    made_names = [*(names[k] for k in kept), *(f"__new{i}" for i in range(len(fields)))]
    kinds = [*(df.schema[k] for k in kept), *fields]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(made_names, kinds)])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[list[pa.Array]]:
            for batch in batches:
                size = sum(c.nbytes for c in batch.columns[len(kept) :])
                step = max(1, -(-batch.num_rows * slice_bytes // max(size, slice_bytes)))
                for at in range(0, batch.num_rows, step):
                    held.append(batch.slice(at, step))
                    yield held[-1].columns[len(kept) :]

        for made in function(feed()):
            rows = len(made[0])
            batch = held[0].slice(0, rows)
            held[0] = held[0].slice(rows)
            if not held[0].num_rows:
                held.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=made_names)

    return work.mapInArrow(run, schema).toDF(*[df.columns[k] for k in kept], *[f.name for f in fields])


def bit_filter(keys: DataFrame, key: str, size: int) -> np.ndarray:
    """A filter of `size` bits, a power of two, that the bigint keys set, 64 bits in a
    number. Its size is fixed, whatever the number of keys; a filter that is too small
    lets more through and never less."""
    bit = F.col(key).bitwiseAND(size - 1)
    word = F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))"))
    rows = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(word.alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned key is set."""
    at = key & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Shared:
    """A broadcast object of one of this package's classes. Its fields are plain
    data, so executors need not import the class to read them."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.kind, self.fields = type(value), spark.sparkContext.broadcast(vars(value))

    def get(self) -> object:
        made = object.__new__(self.kind)
        made.__dict__.update(self.fields.value)
        return made


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nulls are empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


#: Maps A-Z to a-z, and to a space each ASCII byte that is no letter or digit; other bytes stay.
_WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return text.translate(_WORD_TABLE).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; bytes.lower and
    bytes.split know ASCII only."""
    return text.lower().split()
