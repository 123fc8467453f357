"""Queries that write through a sink or a stream and read back what is there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyweave.plans import templates
from tallyweave.plans.fixtures import table
from tallyweave.plans.registry import query
from tallyweave.sources import files as S
from tallyweave.streaming import intake


def scratch(spark: SparkSession) -> str:
    """A new folder among the files that all executors share; one of the driver's own
    only where the session runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='scratch-')}/scratch-{uuid.uuid4().hex}"


@query("s9_csv", "SELECT p_partkey, p_name, p_size FROM part")
def s9(spark, d):
    path = scratch(spark)
    S.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_size int").csv(path)


@query("s10_export", "SELECT row_id, memo, money FROM {statement}")
def s10(spark, d):
    path = scratch(spark)
    s = table(spark, d, "statement")
    S.export(s.groupBy("file_id").count(), s, path, ["memo", "money", "row_id"])
    back = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("memo string, money string, row_id bigint").csv(f"{path}/detail")
    return back.select("row_id", "memo", "money")


@query("s11_split", "SELECT row_id, file_id AS summary_id FROM {statement}")
def s11(spark, d):
    path = scratch(spark)
    s = table(spark, d, "statement").select("row_id", F.col("file_id").alias("summary_id"))
    S.split_by_summary(s.select("summary_id").distinct(), s, path)
    return spark.read.parquet(path).select("row_id", F.col("summary_id").cast("bigint").alias("summary_id"))


@query("s12_log", "SELECT rec_id, type_id FROM {exceptions}")
def s12(spark, d):
    path = scratch(spark)
    for k in (0, 1):
        S.append_log(table(spark, d, "exceptions").where(F.col("type_id") % 2 == k).select("rec_id", "type_id"), path)
    return spark.read.schema("rec_id bigint, type_id int").json(path)


@query("s13_replaced_batches", "SELECT rec_id, batch_id, CASE WHEN batch_id < 10 THEN type_id + 100 ELSE type_id END AS type_id FROM {exceptions} WHERE NOT (batch_id < 10 AND type_id = 1)")
def s13(spark, d):
    path = scratch(spark)
    e = table(spark, d, "exceptions").select("rec_id", "batch_id", "type_id")
    S.replace_batches(e, path)
    S.replace_batches(e.where("batch_id < 10 and type_id <> 1").withColumn("type_id", F.col("type_id") + 100), path)
    return spark.read.parquet(path).select("rec_id", F.col("batch_id").cast("bigint").alias("batch_id"), "type_id")


@query("d8_full_replace", "SELECT user_id, event_id FROM events")
def d8(spark, d):
    path = scratch(spark)
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    e.where("event_type = 'click'").select("user_id", "event_id").write.parquet(path)
    e.select("user_id", "event_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("t2_page_intake", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 13 <> 0")
def t2(spark, d):
    path = scratch(spark)
    cut = F.when(F.col("event_id") % 13 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    pages = table(spark, d, "events").select("event_id", cut.alias("payload"))
    pages.write.parquet(f"{path}/in")
    intake.page_intake(spark, f"{path}/in", pages.schema, "payload", f"{path}/out", f"{path}/cp").awaitTermination()
    return intake.committed(spark, f"{path}/out").select("event_id", F.element_at("record", "k").alias("k"))


@query("t1_sync_intake", "SELECT c.c_custkey, coalesce(n.c_name, c.c_name) AS c_name, n.c_custkey IS NOT NULL AS active FROM customer c LEFT JOIN {customer_new} n ON n.c_custkey = c.c_custkey")
def t1(spark, d):
    path = scratch(spark)
    new = table(spark, d, "customer_new").select("c_custkey", "c_name")
    new.write.parquet(f"{path}/in")
    target = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(True).alias("active"))
    intake.sync_intake(spark, f"{path}/in", new.schema, "c_custkey", ["c_name"], lambda: target, lambda df: df.write.mode("overwrite").parquet(f"{path}/out"), f"{path}/poll")
    return spark.read.parquet(f"{path}/out").select("c_custkey", "c_name", "active")


# One configured template for each region: its labels and types are in JSON files alone.
@query("u2_configured_templates", """SELECT o_orderkey AS row_id, r_name AS template, CAST(o_orderkey AS VARCHAR) AS serial_no, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS transaction_date,
    CAST(round(o_orderkey * 1.25, 2) AS DECIMAL(18, 2)) AS income, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || CAST(o_custkey AS VARCHAR) END AS counterparty FROM orders JOIN region ON r_regionkey = o_custkey % 5""")
def u2(spark, d):
    path, label = scratch(spark), lambda name: F.concat(F.lit(name), F.col("r_regionkey").cast("string"))
    entry = lambda name, field, kind: F.create_map(label(name), F.create_map(F.lit("field"), F.lit(field), F.lit("type"), F.lit(kind)))
    schema = F.array(entry("号", "serial_no", "string"), entry("日", "transaction_date", "datetime"), entry("入", "income", "amount"), entry("方", "counterparty", "string"))
    config = F.struct(F.col("r_name").alias("template_id"), F.struct(F.array(F.concat(F.lit("bank of "), F.lower("r_name"))).alias("keywords")).alias("detection"), schema.alias("transaction_schema"))
    table(spark, d, "region").select(F.to_json(config).alias("value"), "r_name").repartition("r_name").write.partitionBy("r_name").text(path)
    configs = templates.read_configs(spark, path)
    n = F.col("o_custkey") % 5
    named = lambda name: F.concat(F.lit(name), n.cast("string"))
    day = F.when(F.col("o_orderkey") % 11 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy年M月d日"))
    values = F.map_from_arrays(F.array(named("号"), named("日"), named("入"), named("方")), F.array(F.col("o_orderkey").cast("string"), day, F.format_number(F.col("o_orderkey") * 1.25, 2), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("B"), F.col("o_custkey").cast("string"))).otherwise(" ")))
    regions = table(spark, d, "region").select((F.col("r_regionkey")).alias("n"), F.concat(F.lit("Statement of BANK OF "), "r_name", F.lit(" (copy)")).alias("head"))
    # A statement's head is told once, not once a row.
    regions = regions.select("n", templates.recognised(F.col("head"), configs).alias("bank"))
    rows = table(spark, d, "orders").withColumn("n", n).join(F.broadcast(regions), "n")
    told = rows.select(F.col("o_orderkey").alias("row_id"), "bank", values.alias("values"))
    made = templates.configured(configs, configs[0]["template_id"]).project(told, "bank")
    return made.select("row_id", "template", "serial_no", "transaction_date", F.col("income").cast("decimal(18,2)").alias("income"), "counterparty")
