"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is the sum of one word of each of several codebooks, all of the vector's full dimension. Codes are
found by beam search; codebooks are fitted to residuals and then all together. The index stores each vector's
codes and norms. A query's inner product with a vector is the sum of its products with the vector's words,
looked up in a table and corrected by the stored norms; over all vectors the best are scored again with the
vectors themselves, which are fetched for nothing else. The number scored again doesn't grow with the index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_dir, written

BOOKS = 16
WORDS = 256
BEAM = 8
#: Bound of the sample that the codebooks are fitted to; every vector is indexed.
SAMPLE = 8192
#: Codes that are searched together, and vectors that are held together to be scored again.
GROUP, HELD = 1 << 17, 1 << 15
#: Vectors, equal ones counted once, that are scored again for each query.
RERANK = 1024
NEAREST = 20
#: Queries that are scored together.
QUERIES = 64


@dataclass
class Quantiser:
    books: np.ndarray  # books, words, dimension

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The codes of each row, by beam search over the codebooks in turn."""
        return np.concatenate([self._encode(x[a : a + 1024], beam) for a in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(self.books)), np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, d = x.shape
        left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            words = len(book)
            wide = left.shape[1]
            error = (left**2).sum(axis=2)[:, :, None] - 2 * (left.reshape(-1, d) @ book.T).reshape(n, wide, words) + (book**2).sum(axis=1)
            error = error.reshape(n, -1)
            keep = min(beam, error.shape[1])
            best = np.argpartition(error, keep - 1, axis=1)[:, :keep] if keep < error.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            parent, word = best // words, best % words
            left = np.take_along_axis(left, parent[:, :, None], axis=1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), (left**2).sum(axis=2).argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, k]] for k, book in enumerate(self.books))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> Quantiser:
    """Codebooks of the rows of x: k-means of what the books before leave, then least squares for all books
    at once given the codes, and new codes by beam search."""
    r = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        centre = left[r.choice(len(left), words, replace=False)].copy()
        for _ in range(6):
            near = ((centre**2).sum(axis=1) - 2 * left @ centre.T).argmin(axis=1)
            count = np.bincount(near, minlength=words)
            total = np.stack([np.bincount(near, weights=left[:, j], minlength=words) for j in range(left.shape[1])], axis=1)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], left[r.choice(len(left), words)]).astype(np.float32)
        near = ((centre**2).sum(axis=1) - 2 * left @ centre.T).argmin(axis=1)
        found.append(centre)
        left = left - centre[near]
    model = Quantiser(np.stack(found))
    for _ in range(rounds):
        codes = model.encode(x)
        columns = codes.astype(np.int64) + words * np.arange(books)
        pair = lambda i, j: np.bincount(codes[:, i].astype(np.int64) * words + codes[:, j], minlength=words * words).reshape(words, words).astype(np.float32)
        gram = np.block([[pair(i, j) for j in range(books)] for i in range(books)])
        gram[np.diag_indices(len(gram))] += np.float32(0.1)  # the words of before, lightly
        right = np.stack([np.bincount(columns.ravel(), weights=np.repeat(x[:, d], books), minlength=books * words) for d in range(x.shape[1])], axis=1).astype(np.float32)
        prior = model.books.reshape(books * words, -1)
        model = Quantiser(np.linalg.solve(gram, right + np.float32(0.1) * prior).reshape(books, words, -1).astype(np.float32))
    return model


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that are not null or zero, hold numbers only and have the commonest length."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.where(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of each row for which the column is_query, a
    function of id, is true.

    Scores are exact; which rows are scored is approximate. All codes are searched by all queries, block by block,
    so no row is left out; equal vectors, however many, count once and are named in order of id. Null, zero,
    non-finite vectors, those that hold nulls and those of another length than most take no part, nor do null
    ids. A row isn't its own neighbour, but its copy with another id is. No usable vectors give no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    work = work_dir(spark)
    rows = written(usable(vectors, id_col, vector_col), f"{work}/vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.where(draw < 1.5 * SAMPLE / n).select("v").orderBy(draw).limit(SAMPLE).collect() or rows.select("v").limit(SAMPLE).collect()
    model = spark.sparkContext.broadcast(fit(np.array([r[0] for r in sample])))

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), batch.num_rows)
                codes = model.value.encode(x.astype(np.float32))
                norms = [pa.array(np.linalg.norm(y, axis=1).astype(np.float64)) for y in (x, model.value.decode(codes))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), *norms], ["id", "codes", "norm", "code_norm"])

    index = written(rows.mapInArrow(coded, "id bigint, codes binary, norm double, code_norm double"), f"{work}/index")
    queries = rows.where(is_query(F.col("id")))
    chosen = written(_candidates(index, queries, model, n, k), f"{work}/chosen")
    best = written(_scored(rows, queries, chosen, n, k), f"{work}/best")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).repartition("grp").sortWithinPartitions("grp", "kind")


def _parts(batches):
    """(group, kind, rows) of batches sorted by both, in order."""
    for batch in batches:
        grp, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])]) if len(grp) else []
        for a, b in zip(cut, [*cut[1:], len(grp)]):
            yield int(grp[a]), int(kind[a]), batch.slice(int(a), int(b - a))


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … count[0] of them, then those of the next."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _candidates(index: DataFrame, queries: DataFrame, model, n: int, k: int) -> DataFrame:
    """(query_id, id): the RERANK best of each query by its tables, over all groups of the index.

    A group gives each query what of the RERANK best may lie in it, four times the expected share at least. Rows
    with the same codes and norm are copies: they are looked up once and count once, and the k + 1 smallest ids of
    them in each group go on.
    """
    groups = math.ceil(n / GROUP)
    quota = min(RERANK, math.ceil(4 * RERANK / groups) + k)
    nothing = {c: F.lit(None).cast(t) for c, t in (("codes", "binary"), ("norm", "double"), ("code_norm", "double"), ("v", "array<double>"))}
    columns = ["grp", "kind", "id", "codes", "norm", "code_norm", "v"]
    coded = index.withColumns({"grp": F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).cast("int"), "kind": F.lit(0), "v": nothing["v"]}).select(columns)
    asked = queries.withColumns({c: nothing[c] for c in columns[3:6]} | {"grp": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "kind": F.lit(1)}).select(columns)

    def search(batches):
        group, parts, ready = None, [], None

        def prepared():
            ids, codes, norm, code_norm = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, norm, *codes.T))
            ids, codes, norm, code_norm = ids[order], codes[order], norm[order], code_norm[order]
            new = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1) | (norm[1:] != norm[:-1])]
            first = np.flatnonzero(new)
            scale = (norm[first] / np.maximum(code_norm[first], 1e-30)).astype(np.float32)
            return codes[first].T.astype(np.int64), scale, ids, first, np.diff(np.r_[first, len(ids)])

        def answers(names: np.ndarray, x: np.ndarray):
            codes, scale, ids, first, size = ready
            tables = np.einsum("qd,bwd->bqw", x.astype(np.float32), model.value.books, optimize=True)
            guess = np.zeros((len(names), len(first)), np.float32)
            for b in range(len(tables)):
                guess += np.take(tables[b], codes[b], axis=1)
            guess *= scale
            top = min(quota, len(first))
            pick = np.argpartition(-guess, top - 1, axis=1)[:, :top] if top < len(first) else np.broadcast_to(np.arange(top), (len(names), top))
            pick, query, value = pick.ravel(), np.repeat(names, top), np.take_along_axis(guess, pick, axis=1).ravel()
            count = np.minimum(size[pick], k + 1)
            found, query, value = ids[_ragged(first[pick], count)], np.repeat(query, count), np.repeat(value, count)
            other = found != query
            return pa.RecordBatch.from_arrays([pa.array(query[other]), pa.array(found[other]), pa.array(value[other])], ["query_id", "id", "guess"])

        for grp, kind, part in _parts(batches):
            if grp != group:
                group, parts, ready = grp, [], None
            ids = part.column(2).to_numpy()
            if kind == 0:
                parts.append((ids, np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1), part.column(4).to_numpy(), part.column(5).to_numpy()))
            elif parts:
                ready = ready or prepared()
                x = _matrix(part.column(6), part.num_rows)
                for a in range(0, len(ids), QUERIES):
                    yield answers(ids[a : a + QUERIES], x[a : a + QUERIES])

    found = _dealt(coded, asked).mapInArrow(search, "query_id bigint, id bigint, guess float")
    nth = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("guess")))  # copies share a guess
    return found.withColumn("nth", nth).where(F.col("nth") <= RERANK).select("query_id", "id")


def _scored(rows: DataFrame, queries: DataFrame, chosen: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, id, score): of the chosen, in each group of vectors, the k of each query with the largest scores."""
    groups = math.ceil(n / HELD)
    bucket = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(groups)).cast("int")
    held = rows.select(bucket.alias("grp"), F.lit(0).alias("kind"), "id", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    lists = chosen.select("query_id", "id", bucket.alias("grp")).groupBy("grp", "query_id").agg(F.collect_set("id").alias("ids"))
    asked = lists.join(queries.select(F.col("id").alias("query_id"), "v"), "query_id").select("grp", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "ids", "v")

    def score(batches):
        group, parts, ready = None, [], None
        for grp, kind, part in _parts(batches):
            if grp != group:
                group, parts, ready = grp, [], None
            ids, v = part.column(2).to_numpy(), _matrix(part.column(4), part.num_rows)
            if kind == 0:
                parts.append((ids, v))
                continue
            if not parts:
                continue
            if ready is None:
                names, x = (np.concatenate(y) for y in zip(*parts))
                order = np.argsort(names, kind="stable")
                ready, parts = (names[order], x[order] + 0.0), parts[:1]
            names, x = ready
            out = ([], [], [])
            for query, q, wanted in zip(ids.tolist(), v, part.column(3)):
                wanted = np.sort(wanted.values.to_numpy())
                low, high = np.searchsorted(names, wanted), np.searchsorted(names, wanted, "right")
                at = _ragged(low, high - low)
                exact = (x[at] * q).sum(axis=1)
                top = np.lexsort((names[at], -exact))[:k]
                out[0].append(np.full(len(top), query))
                out[1].append(names[at[top]])
                out[2].append(exact[top])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in out], ["query_id", "id", "score"])

    return _dealt(held, asked).mapInArrow(score, "query_id bigint, id bigint, score double")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
