"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams, of 1 to 4 characters, that both have,
over the geometric mean of the numbers that each has. Texts are mapped by their kernels with landmark texts
(Nyström), and one ridge regression for each language tells it from the rest. As the kernel is linear in the
presence of n-grams, landmarks and weights are multiplied once into a matrix of n-grams by languages, and a
batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_chunks, texts_of

ORDERS = 4
#: n-grams are told apart by so many bits of hash.
BITS = 15
#: Bounds of the sample that is learned from: texts a language, and landmarks among them in all.
SAMPLE = 300
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams each text has, as a matrix of 0 and 1, and whether it has a letter.

    Texts are lower-cased; what isn't a letter counts as a space, and spaces that adjoin as one.
    """
    out = np.zeros((len(texts), 1 << BITS), dtype=np.uint8)
    any_letter = np.zeros(len(texts), dtype=bool)
    letter = _letters()
    for k, text in enumerate(texts):
        lowered = f" {text.decode('utf-8', 'replace').lower()} "
        codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        solid = letter[codes]
        any_letter[k] = solid.any()
        if not any_letter[k]:
            continue
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        keep[0] = True
        codes = np.where(solid, codes, 32)[keep].astype(np.uint64)
        gram = np.zeros(len(codes), np.uint64)
        for order in range(1, min(ORDERS, len(codes)) + 1):
            last = len(codes) - order + 1
            gram = gram[:last] * np.uint64(0x1F0001) + codes[order - 1 :]
            out[k, ((gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = 1
    return out, any_letter


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-grams by languages
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        there, letters = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        size = np.sqrt(np.maximum(there.sum(axis=1, dtype=np.float64), 1))
        values = (there.astype(np.float32) @ self.weights) / size[:, None] + self.bias
        e = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        best = values.argmax(axis=1)
        score = e[np.arange(len(e)), best] / e.sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters)], np.where(letters, score, 0.0)


def learned(there: np.ndarray, labels: list[str]) -> Model:
    """The model of texts with presence matrix there; they are in random order."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(x) for x in labels])
    each = max(1, LANDMARKS // len(languages))
    landmark = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])
    p = there.astype(np.float32) / np.sqrt(np.maximum(there.sum(axis=1, dtype=np.float32), 1))[:, None]
    base = p[landmark]
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = (p @ base.T).astype(np.float64) @ root
    weight = 1 / np.bincount(y)[y]  # every language weighs the same
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    a = np.hstack([mapped, np.ones((len(y), 1))])
    gram = (a * weight[:, None]).T @ a + RIDGE * np.eye(a.shape[1])
    gram[-1, -1] -= RIDGE
    solved = np.linalg.lstsq(gram, (a * weight[:, None]).T @ target, rcond=None)[0]
    return Model(languages, (base.T @ (root @ solved[:-1])).astype(np.float32), solved[-1])


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows for which the column learn is true and the language is known.

    Of each language SAMPLE rows at most, those of smallest hash: languages are counted first, so that about
    twice as many pass a threshold of the hash and few are sorted. Only their presence bits reach the driver.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return learned(np.zeros((0, 1 << BITS), np.uint8), [])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * SAMPLE / n + 20 / n))]), F.col(lang_col))
    some = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw")).where(F.col("draw") < share)
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).select("k", "text", "lang")

    def run(batches):
        for batch in in_chunks(batches):
            there, ok = presence(texts_of(batch.column(1)))
            bits = [row.tobytes() for row in np.packbits(there, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary()), pa.array(ok)], ["k", "lang", "bits", "ok"])

    got = sorted((r for r in chosen.mapInArrow(run, "k int, lang string, bits binary, ok boolean").collect() if r["ok"]), key=lambda r: (r["k"], r["lang"]))
    there = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1) if got else np.zeros((0, 1 << BITS), np.uint8)
    return learned(there, [r["lang"] for r in got])


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: UNKNOWN with score 0 where the text is null or has no letter, or
    where no language was learned. Repeated rows and null ids get a row each; no rows give no rows."""

    def run(batches):
        for batch in in_chunks(batches):
            texts = texts_of(batch.column(1))
            for a in range(0, len(texts), 256):
                names, score = model.predict(texts[a : a + 256])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(names), pa.array(score)], [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` bigint, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identified(docs, fit(docs, ~out_of))
    return found.select("doc_id", out_of.alias("held_out"), "lang_pred", "score")
