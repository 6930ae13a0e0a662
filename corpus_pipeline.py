"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of docs; the last returns
pieces of sequences. run() writes every stage's result and reads it again, as a driver of STAGES would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontamination, packing, quality, secrets, similar
from touchline.llm.common import work_dir, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of docs, save those held out.

    A null text is scored as the empty one; rows that repeat, and rows without an id, are judged by their text
    like any other. Without labels of both classes nothing is rejected that the share of label 1 wouldn't. No rows
    give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = written(quality.features(docs), f"{work_dir(spark)}/features")
    return quality.keep_good(docs, quality.fit(x, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id, once.

    Close SimHash fingerprints and shared minima of shingles are candidates; five-word shingles with a Jaccard
    similarity of 0.8 or more make the groups. Rows that share an id but not their text are different documents;
    rows without an id are grouped by text, after those with one. Rows with neither id nor words stay.
    """
    return similar.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A document is known by its text, so equal texts share their fate and
    rows that only share an id don't. Null and empty texts hold nothing and stay; without items all stay."""
    named = docs.withColumn("_text", F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 32)))
    found = decontamination.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_text")
    keys = written(found.select("_text").distinct(), f"{work_dir(spark)}/contaminated")
    few = keys.count() <= decontamination.BROADCAST_ROWS
    return named.join(F.broadcast(keys) if few else keys, "_text", "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows. Null and empty texts stay as they are, repeated rows
    and rows without an id are treated alike, and no rows give no rows."""
    return secrets.redacted(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens. A null or empty text is its closing id alone; repeated
    rows and rows without an id have pieces of their own; no rows give no rows."""
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: The stages' models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{work}/{k}_{name}")
    return docs
