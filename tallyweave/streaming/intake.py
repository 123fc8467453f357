"""Incremental jobs: page payloads cleaned as they arrive, and a target kept in step
with a source. Both take every file once and stop when none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators import sync
from tallyweave.sources import files


def page_intake(spark: SparkSession, source: str, schema: T.StructType, payload: str, out: str, checkpoint: str) -> StreamingQuery:
    """Records of new payload files under `source` added to `out`; payloads that do
    not parse go to `out`_bad. Each batch has a folder of its own, so that a batch that
    runs again replaces its rows, and an entry in `out`_done that is written last:
    committed() reads batches with an entry only, so that it never sees half of one."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # both writes read it
        good, bad = files.records(batch, payload)
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}_bad/batch={number}")
        spark.range(number, number + 1).withColumnRenamed("id", "batch").write.mode("overwrite").json(f"{out}_done/entry={number}")
        batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, bad: bool = False) -> DataFrame:
    """Rows of the batches that page_intake() has finished, or of those that did not
    parse; `batch` is a column of theirs. Only listed batches' folders are read."""
    done = spark.read.schema("batch bigint").json(f"{out}_done").select("batch")
    return spark.read.parquet(f"{out}_bad" if bad else out).join(F.broadcast(done), "batch", "left_semi")


def sync_intake(spark: SparkSession, source: str, schema: T.StructType, key: str, fields: list[str], load: Callable[[], DataFrame], store: Callable[[DataFrame], None], poll: str, version: str | None = None) -> None:
    """One poll. All new rows under `source`, however many batches they take, are
    gathered in the folder `poll`, and when none is left they update the target that
    `load` gives; rows that the whole poll lacks become inactive, and `store` keeps the
    result. Of a key's rows the latest `version` counts, then the greatest fields. A
    poll that was cut short goes on where it stopped if it is run again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{poll}/rows/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{poll}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{poll}/rows")
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*([version] if version else []), *fields)).alias("r")).select(key, "r.*")
    updated = sync.apply_changes(load(), latest, key, fields)
    store(sync.disable_missing(updated, latest, key))
