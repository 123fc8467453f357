"""WARC archives: writing pages, and reading any archive back safely.

Writing gives each page one record. Of equal payloads that are long enough only one
is stored; the others become revisit records that name it. Spark's text writer puts
the records down with the record separator as its line end, so archives go to any
store that Spark can write to.

Reading splits archives at the version line, wherever it stands. Every piece is a
candidate: its place in the file and its own headers give an edge to its successor's
place. A payload may hold a version line as well, so candidates prove nothing by
themselves. Pointer jumping from the start of each file marks the candidates that
the chain of records reaches; all others are put back into the payload they were
cut from.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import checkpoint_dir, materialize

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"

#: Payloads of fewer bytes are stored each time.
LEAST_REVISIT = 1000
#: Records of a file at most.
FILE_RECORDS = 20_000
#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 100_000


def _utf8(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest, refers_to) for every row of pages.

    refers_to is the largest page_id among rows of equal payload, null where the row
    has that page_id itself, where the payload is short, or where no row of the
    payload has an id. A null html is an empty payload. Rows that share the largest
    page_id are all stored. Payloads are equal if their SHA-256 is."""
    payload = pages.select("page_id", "url", _utf8(F.col("html")).alias("payload"))
    same = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).alias("same")
    long = payload.where(F.octet_length("payload") >= least).select("page_id", same)
    again = materialize(long.groupBy("same").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").drop("n"))
    rows = payload.select("*", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.sha1(F.col("payload").cast("binary")).alias("digest"), same)
    joined = rows.join(_small(again), "same", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("target")), F.col("target"))
    return joined.select("page_id", "url", "payload", "n_bytes", "digest", refers.alias("refers_to"))


def _small(side: DataFrame) -> DataFrame:
    """A side that was computed before, to be broadcast if it has few rows; beyond
    that Spark joins it by a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def _line(name: str, value: Column | str) -> Column:
    """A header line, left out if its value is null; line ends in a value become blanks."""
    text = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), "[\r\n]", " ")
    return F.concat(F.lit(f"{name}: "), text, F.lit("\r\n"))


def record() -> Column:
    """The text of one record of plan_records, without the separator after it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("n_bytes")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = [
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", "1970-01-01T00:00:00Z"),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.when(revisit, _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block)),
    ]
    return F.concat(F.lit(MAGIC), *head, F.lit("\r\n"), block)


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Archives of all rows of pages under this path, in files of bounded size."""
    records = plan_records(pages, least)
    records.select(record().alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _chain(table: pa.Table, size: int) -> pa.Table:
    """What the chain of records from the file's start says of its pieces: the place
    of the record that each belongs to, or null, by pointer jumping. Only pieces
    that are not a whole record by themselves are returned."""
    table = table.sort_by([("part", "ascending"), ("row", "ascending")])
    n_bytes, head, body = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n_bytes", "head", "body"))
    n = len(n_bytes)
    place = np.cumsum(n_bytes + size) - n_bytes - 2 * size  # of the version line before each piece
    successor = np.where(body < 0, -1, place + size + head + len(END) + body + len(END))
    at = np.minimum(np.searchsorted(place, successor), n - 1)
    to = np.append(np.where((place[at] == successor) & (body >= 0), at, n), n)  # n: no such piece
    reached = np.append(place == 0, False)
    while (to < n).any():
        reached[to[np.flatnonzero(reached)]] = True
        reached[n] = False
        to = to[to]
    reached = reached[:n]
    owner = np.maximum.accumulate(np.where(reached, np.arange(n), -1))
    shares = np.bincount(owner[owner >= 0], minlength=n)
    odd = (owner < 0) | (shares[np.maximum(owner, 0)] > 1)
    kept = table.filter(pa.array(odd)).select(["file", "part", "row"])
    kept = kept.append_column("place", pa.array(place[odd]))
    return kept.append_column("owner", pa.array([None if o < 0 else int(place[o]) for o in owner[odd]], pa.int64()))


def _header(text: Column, name: str) -> Column:
    """The first value of a header among the lines of a head, or null."""
    found = F.regexp_extract(text, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def read(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """(head, block) of every record under this path: the header lines as text and
    the declared number of bytes after them. What no chain from the start of a file
    reaches is not a record; a chain ends where a record's length does not lead to
    another record. Records of a file may come in any order."""
    lines = spark.read.option("lineSep", magic).text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row")]
    pieces = lines.select(*where, F.col("value").alias("piece"))
    head = F.substring_index("piece", END, 1)
    length = F.when(F.instr("piece", END) > 0, F.expr("try_cast(length as bigint)"))
    scanned = pieces.withColumn("head", head).withColumn("length", _header(F.col("head"), "content-length"))
    candidates = scanned.select(
        "file", "part", "row", F.octet_length("piece").cast("bigint").alias("n_bytes"), F.octet_length("head").cast("bigint").alias("head"), F.coalesce(length, F.lit(-1)).cast("bigint").alias("body")
    )
    size = len(magic)
    odd = materialize(candidates.groupBy("file").applyInArrow(lambda t: _chain(t, size), "file string, part bigint, row bigint, place bigint, owner bigint"))
    joined = pieces.join(_small(odd.withColumn("odd", F.lit(True))), ["file", "part", "row"], "left")
    whole = joined.where("odd is null").select("piece")
    parts = joined.where("odd and owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("parts"))
    glued = parts.select(F.array_join(F.col("parts.piece"), magic).alias("piece"))
    record = whole.union(glued).withColumn("head", head)
    size_of = _header(F.col("head"), "content-length").cast("int")
    return record.select("head", F.substring(F.col("piece").cast("binary"), F.octet_length("head") + len(END) + 1, size_of).alias("block"))


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)
    of records that write() put down. A revisit's payload is null here; its size and
    digest are those that its headers tell of the full payload. A response's are
    worked out from its bytes."""
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    parsed = records.select("head", "block", http.alias("http"), F.lower(_header(F.col("head"), "warc-type")).alias("record_type"))
    payload = F.when(F.col("record_type") == "response", F.expr(f"substring(block, octet_length(http) + {len(END) + 1})"))
    number = lambda name: F.regexp_extract(_header(F.col("head"), name), "^<urn:page:(-?[0-9]+)>$", 1)
    told = parsed.withColumn("payload", payload)
    return told.select(
        number("warc-record-id").try_cast("bigint").alias("page_id"),
        _header(F.col("head"), "warc-target-uri").alias("url"),
        "payload",
        F.coalesce(F.octet_length("payload"), _header(F.col("http"), "content-length").try_cast("int")).cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.regexp_extract(_header(F.col("head"), "warc-payload-digest"), "^sha1:([0-9a-f]+)$", 1)).alias("payload_digest"),
        "record_type",
        number("warc-refers-to").try_cast("bigint").alias("refers_to"),
    )


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives among the files that all executors share."""
    return f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
