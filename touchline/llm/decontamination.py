"""Benchmark decontamination: short test items inside long documents, with DataFrame functions only.

Containment of an item is the share of its distinct shingles that a document has too. Items are partitioned
by size; a partition's sketch is the k smallest shingle hashes of each item (bottom-k MinHash), with k such
that a document that holds the wanted share of the item holds one of the k at least: of n shingles, n minus
the wanted number may be missing, so one more cannot all be. The candidates that share a sketch hash are
verified by their shingles themselves. Probing with a fixed number of permutations instead would miss an item
of 40 words in a document of 20,000: their Jaccard similarity is about 0.002.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_dir, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch rows (16 bytes each) up to which they are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _normalised(text: Column) -> Column:
    """Lower-case runs of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _shingles(normalised: Column, lengths: list[int]) -> Column:
    """All runs of so many words, for each length, repeats included."""
    runs = [F.regexp_extract_all(normalised, F.lit(rf"\G ?(?=(\S++(?: \S++){{{n - 1}}}))\S++"), F.lit(1)) for n in lengths]
    return F.concat(*runs)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words, shingles): an item of fewer than SHINGLE words is one shingle; one of none is left out.

    item is a key of id and text, never null. Should two items share it, both are verified."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), _normalised(F.col(text_col)).alias("norm")).where("norm <> ''").distinct()
    n = F.least(F.size(F.split("norm", " ")), F.lit(SHINGLE))
    return rows.select(F.xxhash64("item_id", "norm").alias("item"), "item_id", n.alias("words"), F.array_distinct(F.when(n < SHINGLE, F.array("norm")).otherwise(_shingles(F.col("norm"), [SHINGLE]))).alias("shingles"))


def _wanted(n: Column) -> Column:
    return F.ceil(n * F.lit(CONTAINMENT) - F.lit(1e-9)).cast("int")


def sketches(items: DataFrame) -> DataFrame:
    """(hash, item, least): the bottom-k hashes of each item; least is the fewest shingles of a document with it."""
    n = F.size("shingles")
    sized = items.select("item", n.alias("n"), F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s))).alias("hashes"), F.floor(F.log2(n)).alias("part"))
    upper = F.greatest(F.pow(F.lit(2), F.col("part") + 1).cast("int") - 1, F.col("n"))  # logarithms may round down
    k = upper - _wanted(upper) + 1
    return sized.select("item", _wanted(F.col("n")).alias("least"), F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, containment), distinct: the items of which a row of docs has CONTAINMENT or more.

    Text is compared by its lower-cased letters and digits. Null and empty texts hold and are nothing. Rows
    and items that repeat give one result; a null id, of a row or of an item, is reported as null. No rows or no
    items give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work = work_dir(spark)
    items = written(_items(benchmark, item_col, item_text_col), f"{work}/items")
    lengths = sorted(r[0] for r in items.select("words").distinct().collect()) or [SHINGLE]  # five values at most
    sketch = written(sketches(items).distinct(), f"{work}/sketch")
    few = sketch.count() <= BROADCAST_ROWS
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    cut = rows.select("key", _shingles(_normalised(F.col("text")), lengths).alias("shingles"))
    probes = cut.select("key", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")).select("key", "size", F.xxhash64("shingle").alias("hash"))
    pairs = probes.join(F.broadcast(sketch) if few else sketch, "hash").where("size >= least").select("key", "item").distinct()
    candidates = written(pairs, f"{work}/candidates")
    # Few candidates are broadcast to the texts, many are joined by a shuffle. Rows that share a key are all verified.
    sent = F.broadcast if candidates.count() <= BROADCAST_ROWS else (lambda df: df)
    found = rows.join(sent(candidates.select("key").distinct()), "key", "left_semi").select("id", "key", F.array_distinct(_shingles(_normalised(F.col("text")), lengths)).alias("held"))
    both = found.join(sent(candidates), "key").join(items, "item")
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    wanted = both.select("id", "item_id", share.alias("containment")).where(F.col("containment") >= CONTAINMENT - 1e-9)
    return wanted.distinct().withColumnRenamed("id", id_col)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') FROM benchmark
),
runs AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM words
),
sizes AS (SELECT id, count(*) AS n FROM runs WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, round(count(*) / any_value(n), 6) AS containment
FROM runs d JOIN runs b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id HAVING count(*) / any_value(n) >= 0.8 - 1e-9
"""
