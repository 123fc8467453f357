"""Corpus pipeline: documents in, clean encoded documents out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents, in order and unchanged but for
redacted texts and their n_chars; other columns stay, whatever their names. A null text
counts as empty and stays null where the row stays; repeated rows get one verdict each,
and near_duplicates keeps one of them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, nearcopies, pieces, pii, toxicity
from tallyweave.llm.common import held_out, rewritten, with_columns_of


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from labelled
    documents whose id's crc32 leaves a remainder other than 0 by 5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.remove_toxic(docs, toxicity.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word Jaccard similarity 0.8 or
    more connect, that of the smallest id. SimHash proposes pairs, each is confirmed
    exactly, and an exact filter finds the pairs that fingerprints leave apart."""
    return nearcopies.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data redacted; n_chars follows the text."""
    cleaned = pii.redact(docs, pii.fit(pii.count_features(pii.with_candidates(docs))))
    return with_columns_of(cleaned.withColumn("n_chars", F.length("text").cast("bigint")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encode(docs, pieces.Model.read(pieces.MODEL_PATH))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: Trained models, fingerprints and pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; between stages they are written to the shared
    folder, so that none is worked out twice and a lost executor costs a reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
