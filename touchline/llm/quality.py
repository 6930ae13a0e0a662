"""Document quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, texts_of, work_dir, written

#: Share of the pooled and of the spherical covariance in each class's own.
POOLED, SPHERICAL = 0.05, 0.02
THRESHOLD = 0.3

STATISTICS = ("words", "word_length", "upper", "digits", "symbols", "marked_words", "bars", "shouts", "distinct", "commonest", "doubled", "lines", "repeated_lines", "plain_stops")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS. Shares go through an arcsine of
    their square root, counts through a logarithm, so that their spread depends less on their level."""
    words = text.split()
    n = max(len(words), 1)
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    blank = octets[9:14].sum() + octets[32]
    solid = max(len(text) - blank, 1)
    upper, lower = octets[65:91].sum(), octets[97:123].sum()
    marks = octets[33:48].sum() + octets[58:65].sum() + octets[91:97].sum() + octets[123:127].sum()
    commas = octets[44] + octets[46]
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    shares = {
        "upper": upper / max(upper + lower, 1),
        "digits": octets[48:58].sum() / solid,
        "symbols": (marks - commas) / solid,
        "marked_words": min(1.0, (octets[35:39].sum() + octets[42]) / (3 * n)),
        "bars": min(1.0, octets[124] / n),
        "shouts": min(1.0, octets[33] / (2 * n)),
        "distinct": len(counts) / n,
        "commonest": max(counts.values(), default=0) / n,
        "doubled": sum(map(eq, words, words[1:])) / n,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "plain_stops": min(1.0, octets[46] / n),
    }
    values = {name: float(np.arcsin(np.sqrt(x))) for name, x in shares.items()}
    values |= {"words": float(np.log1p(len(words))) / 4, "word_length": float(np.log1p(solid / n)), "lines": float(np.log1p(len(words) / max(len(lines), 1))) / 4}
    return [values[x] for x in STATISTICS]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row; null texts are empty."""

    def run(batches):
        for batch in in_chunks(batches):
            x = np.array([statistics(t) for t in texts_of(batch.column(1))], dtype=np.float64)
            arrays = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], ["id", "x"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, x array<double>")


@dataclass
class Discriminant:
    """Two Gaussians with their Cholesky factors; shares only where a class has too few rows to fit one.

    The factors are inverted once, so that a batch's Mahalanobis distances are one matrix product."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None

    def __post_init__(self):
        self.inverses = None if self.factors is None else np.linalg.inv(self.factors)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of x."""
        if self.means is None:
            return np.full(len(x), self.prior)
        density = []
        for mean, factor, inverse in zip(self.means, self.factors, self.inverses):
            away = inverse @ (x - mean).T
            density.append(-0.5 * (away**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        odds = np.log(self.prior / (1 - self.prior)) + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(x: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", hold_out: int = 5) -> Discriminant:
    """The discriminant of features (id, x) by the labels 0 and 1 of all rows that aren't held out.

    Sums of all labelled rows, with partial aggregation: two rows reach the driver. Labels that are null or
    other than 0 and 1, and null ids, are left out; a row labelled twice counts twice. With fewer than two
    rows of a class the score is the share of label 1, a half where there are no labels.
    """
    d = len(STATISTICS)
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"), hold_out))
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {r["y"]: r for r in x.join(marked, "id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    n = {y: found[y]["n"] if y in found else 0 for y in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant(n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    means, spreads = [], []
    for y in (0, 1):
        mean = np.array([found[y][f"s{i}"] for i in range(d)]) / n[y]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = found[y][f"s{i}_{j}"] / n[y]
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
    pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / (n[0] + n[1])
    factors = []
    for own in spreads:
        mixed = (1 - POOLED) * own + POOLED * pooled
        sphere = np.trace(mixed) / d + 1e-6
        factors.append(np.linalg.cholesky((1 - SPHERICAL) * mixed + SPHERICAL * sphere * np.eye(d)))
    return Discriminant(n[1] / (n[0] + n[1]), np.array(means), np.array(factors))


def held_out(doc_id, parts: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def scored(x: DataFrame, model: Discriminant, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of features (id, x): a row for each, null ids and repeated ones too."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], ["id", "score"])

    out = x.mapInArrow(run, "id bigint, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, as they are; nothing is shuffled. A null text is scored
    as the empty one, equal texts score alike, and no rows give no rows."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in in_chunks(batches, at):
            x = np.array([statistics(t) for t in texts_of(batch.column(at))], dtype=np.float64)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = written(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), f"{work_dir(spark)}/features")
    return scored(x, fit(x, spark.read.parquet(f"{sf_dir}/labels.parquet")))
