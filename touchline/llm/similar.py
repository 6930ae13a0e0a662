"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of JACCARD or more.

The verified form of the SimHash operator, for stages that need a similarity. The components of close
fingerprints are its first candidates. They aren't enough: at a Jaccard of 0.8 about ten of 64 bits differ, and a
limit that holds nearly all such pairs, about twenty, no longer tells texts apart. So texts that share a band of
ROWS minima of hashed shingles are candidates too; a pair at JACCARD shares none of BANDS bands in three of a
million cases. Every link is verified by the shingle sets themselves; the groups are the components of all links.

The texts of a bucket are first compared with its smallest node, each pair once however many buckets it shares.
Where that joins a bucket, no pair of it is left to compare; only in buckets that it doesn't join are all pairs
looked at that aren't joined yet. So a set travels once for each smallest node, not once for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, hand_back, in_chunks, mixed, texts_of, work_dir, written
from .components import components
from .simhash import near_duplicates

SHINGLE = 5
JACCARD = 0.8
BANDS, ROWS = 32, 5
#: Rows of eight bytes up to which a side is sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A bucket of more texts is split into blocks, and each two blocks are compared on their own.
BLOCK = 4096

_R = np.random.default_rng(17)
_FACTORS = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _R.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def node(text: Column) -> Column:
    """The same long for texts of the same words, but for A-Z and white space; null is empty."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.xxhash64(F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of fewer words is one shingle, one of none has none."""
    from xxhash import xxh64_intdigest

    w = Words([t.lower() for t in texts])
    at = w.whole(shingle)
    hashes, doc = w.runs(shingle, at), w.doc[at]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    whole = lambda k: np.array([xxh64_intdigest(b" ".join(w.split[k]))] if w.split[k] else [], dtype=np.uint64)
    return [np.unique(hashes[a:b]) if b > a else whole(k) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


def bands(s: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 2048):
        np.minimum(least, ((s[None, k : k + 2048] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in mixed(least).reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def linked(nodes: np.ndarray, sets: list[np.ndarray], jaccard: float = JACCARD, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between nodes that join what similarity joins. A pair that is joined already, in what is known or
    by the links found, isn't compared."""
    n = len(nodes)
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    sizes, out = np.array([len(s) for s in sets]), []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= jaccard * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        for a in range(0, len(rest), 256):
            some = rest[a : a + 256]
            flat = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat(sets[i][at] == flat, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            for j in some[both >= jaccard * (sizes[i] + sizes[some] - both) - 1e-9].tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def _similar(one: np.ndarray, other: np.ndarray, jaccard: float) -> bool:
    if not len(one) or not len(other):
        return len(one) == len(other)
    both = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return both >= jaccard * (len(one) + len(other) - both) - 1e-9


def _bands(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, band): the bands of each node of docs (node, text) that has words."""

    def run(batches):
        for batch in in_chunks(batches):
            ids, keys = [], []
            for k, s in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch.column(1)), shingle)):
                if len(s):
                    ids.append(k)
                    keys.append(bands(s))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), BANDS)), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], ["node", "band"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, band bigint")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, held): the shingle set of each of nodes (node), distinct, as bytes."""

    def run(batches):
        for batch in in_chunks(batches):
            sets = shingle_sets(texts_of(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "held"])

    few = nodes.count() <= BROADCAST_ROWS
    wanted = docs.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "text")
    return wanted.mapInArrow(run, "node bigint, held binary").dropDuplicates(["node"])


def _with_smallest(edges: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(a, b) of the edges (node, least) whose sets are similar. The set of least comes first in a task and is held
    while the others stream by; a node that is the least of very many is dealt to several tasks."""
    stars = edges.groupBy("least").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    others = edges.join(stars, "least").withColumn("block", block).join(sets, "node").select("least", "block", F.lit(1).alias("kind"), "node", "held")
    first = stars.join(sets, F.col("least") == F.col("node")).select("least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "node", "held")

    def run(batches):
        held, at = np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            for least, block, kind, node_, raw in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    held, at = s.copy(), (least, block)
                elif at == (least, block) and _similar(held, s, jaccard):
                    a.append(node_)
                    b.append(least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        hand_back()

    return first.unionByName(others).repartition("least", "block").sortWithinPartitions("least", "block", "kind").mapInArrow(run, "a bigint, b bigint")


def _all_pairs(members: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(a, b): links that join what similarity joins in each bucket of members (band, n, node, root), where equal roots
    are joined already. A large bucket is split into blocks, and each two blocks are compared on their own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    met = members.select("band", "node", "root", blocks.alias("blocks"), own.alias("own"))
    met = met.select("band", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = met.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "root")

    def run(batches):
        def done(rows):
            nodes, known = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            a, b = linked(nodes, [np.frombuffer(r[2], np.uint64) for r in rows], jaccard, known)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        task, rows = None, []
        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task and rows:
                    yield done(rows)
                    rows = []
                task = t
                rows.append(row)
        if rows:
            yield done(rows)
        hand_back()

    rows = tasks.join(sets, "node").select("task", "node", "root", "held").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(run, "a bigint, b bigint")


def close_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, band): the component of close SimHash fingerprints of each node of docs (node, text)."""
    return near_duplicates(docs, "node", "text", shingle).select("node", F.xxhash64(F.lit("simhash"), "component_id").alias("band"))


def roots(docs: DataFrame, shingle: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """(node, root) of the nodes of docs (node, text), but for those that are their own root."""
    work = work_dir(docs.sparkSession)
    every = written(_bands(docs, shingle).unionByName(close_fingerprints(docs, shingle)).distinct(), f"{work}/bands")
    # Buckets of the same texts are one: its name is the smallest band.
    shared = every.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    shared = shared.where("n > 1").groupBy("n", "least", "x", "y").agg(F.min("band").alias("band")).drop("x", "y")
    members = written(every.join(shared, "band"), f"{work}/members")
    sets = written(_sets(docs, written(members.select("node").distinct(), f"{work}/nodes"), shingle), f"{work}/sets")
    edges = members.where("node <> least").select("node", "least").distinct()
    found = components(written(_with_smallest(edges, sets, jaccard), f"{work}/first"))
    joined = members.join(found.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left").select("band", "n", "node", F.coalesce("root", "node").alias("root"))
    joined = written(joined, f"{work}/joined")
    apart = joined.where("n > 2").groupBy("band").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("band")
    rest = written(_all_pairs(joined.join(apart, "band", "left_semi"), sets, jaccard), f"{work}/rest")
    if rest.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """(id, component_id) of every row: the smallest id that links reach. Texts without words are one group.

    A null id is never the smallest; a group of null ids alone has a null component_id. Repeated rows get a row
    each; no rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), node(F.col(text_col)).alias("node"))
    reached = roots(rows, shingle, jaccard).withColumnRenamed("node", "_node")
    rooted = rows.select("id", "node").join(reached, F.col("node") == F.col("_node"), "left").select("id", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, f"{work_dir(docs.sparkSession)}/rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, jaccard: float = JACCARD) -> DataFrame:
    """docs with one row of each group, the one with the smallest id, null last; of several with that id and
    different columns the one whose digest is least. Of rows equal in all columns one stays.

    A row is known by the digest of all its columns, so rows that only share an id are told apart, and rows
    without an id are grouped by their text like others. A row with neither id nor words is in no group and
    stays. The rows of one text are reduced to the first before texts are grouped, so a text's copies, however
    many, meet in partial aggregation only. No rows give no rows.
    """
    work = work_dir(docs.sparkSession)
    words = F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]")
    outside = F.col(id_col).isNull() & ~F.coalesce(words, F.lit(False))
    flat = [F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema]
    marks = {f"_row{k}": F.xxhash64(F.lit(k), *flat, *[c.isNull() for c in flat]) for k in (1, 2)}  # together the digest of a row
    rows = docs.where(~outside).withColumns(marks)
    base = written(rows.select(*marks, F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text")), f"{work}/base")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *marks)).alias("first")
    texts = written(base.groupBy("node").agg(first), f"{work}/texts")
    found = roots(base.select("node", "text"), shingle, jaccard).withColumnRenamed("node", "_node")
    kept = texts.join(found, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(*[F.col(f"first.{m}").alias(m) for m in marks]), f"{work}/kept")
    # One dealing of the rows by digest serves the join and the removal of equal rows.
    stay = rows.repartition(*marks).join(kept, list(marks), "left_semi").dropDuplicates(list(marks)).select(docs.columns)
    return stay.unionByName(docs.where(outside))
