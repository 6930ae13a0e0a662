"""Token counts with a digest cache: only texts that the cache doesn't know are encoded, each once."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import in_chunks, looked_up, texts_of, work_dir, written

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_digest(name: str) -> str:
    """SHA-256 of the tokenizer's file: another version has other counts."""
    with open(vocabulary_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoded_lengths(docs: DataFrame, tokenizer: str, key: str = "digest", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row. .json files go by tokenizers, .model files by sentencepiece."""

    def run(batches):
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(tokenizer))
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            count = encoder(vocabulary_path(tokenizer)).counts
        for batch in in_chunks(batches):
            texts = [t.decode("utf-8", "replace") for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return docs.select(F.col(key).alias("digest"), F.col(text)).mapInArrow(run, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache's entries, one for each text and tokenizer; a cache that doesn't exist yet is empty."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = TOKENIZER, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs, by way of the cache at cache_path.

    Content is normalised by reading null as the empty text; anything more could change a count. The cache
    grows by the distinct texts it didn't know. Repeated rows and repeated or null ids give a row each; an
    empty text has 0 tokens; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    work, version = work_dir(spark), tokenizer_digest(tokenizer)
    content = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    seen = written(texts.select("id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), f"{work}/digests")
    cache = lambda: read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # A text's copies meet as digests, 32 bytes a row, with partial aggregation; its one row of text is then
    # fetched by id and digest. Written misses have a known size, so few of them are broadcast and many are not.
    rid = F.coalesce(F.col("id").cast("string"), F.lit(""))
    one = written(seen.groupBy("digest").agg(F.min(rid).alias("rid"), F.count("*").alias("copies")), f"{work}/distinct")
    misses = written(one.drop("copies").join(cache(), "digest", "left_anti"), f"{work}/misses")
    rows = texts.withColumn("rid", rid).join(misses, ["digest", "rid"], "left_semi")
    fresh = encoded_lengths(rows, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    known = cache().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two jobs may have appended the same text
    return looked_up(seen, known, one.select("digest", "copies"), "digest", seen.count()).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. Each call begins with an empty cache, so that it does all the work it reports."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark)}/token_cache")
