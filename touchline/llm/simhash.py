"""Near-duplicates by SimHash: fingerprints, links of few differing bits, and their components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments, a point of a grid. The Manhattan
distance of two points is at most the number of differing bits, so fingerprints that differ in at most D bits
lie within D of each other. The join of points within that range goes by projections of the grid: the segments
form g groups, and of two points in range g - D groups at least agree in all their counts. The cells of every
choice of g - D groups are therefore enough; points that meet in a cell are filtered by their Manhattan distance,
and the bits themselves are compared for those that pass. All choices are exact; the more points there are, the
more groups are taken, so that a point meets a bounded number of others by chance.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, texts_of, work_dir, written
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 32
#: Points that a point may meet by chance, over all cells, before more groups are taken.
MET_BY_CHANCE = 1024
#: A cell of more fingerprints is split into blocks, and each two blocks are compared on their own.
BLOCK = 2048

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, by the hashes of its word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: 1 - shingle or None].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the unsigned fingerprint's bits as a long. Null and empty texts: 0."""

    def run(batches):
        for batch in in_chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def groups_for(points: int, distance: int = DISTANCE) -> int:
    """How many groups of segments: the fewest with which a point meets at most MET_BY_CHANCE others by chance.

    A two-bit segment's count holds 1.5 bits. A choice of g - distance of g groups is a cell's key.
    """
    g = distance + 2
    while g < 3 * distance + 8 and log2(max(points, 1)) + log2(comb(g, distance)) - 1.5 * SEGMENTS * (g - distance) / g > log2(MET_BY_CHANCE):
        g += 1
    return g


def embedded(fp):
    """The counts of all two-bit segments, in unary: 00, 01 or 11. Of arrays or columns alike, by their bits: the
    Manhattan distance of two points is the number of bits in which these differ."""
    odd = 0x5555555555555555
    if isinstance(fp, np.ndarray):
        x = fp.view(np.uint64)
        high = x >> np.uint64(1)
        return ((x & high & np.uint64(odd)) << np.uint64(1)) | ((x | high) & np.uint64(odd))
    high = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(high).bitwiseAND(F.lit(odd)), fp.bitwiseOR(high).bitwiseAND(F.lit(odd))
    return F.shiftleft(both, 1).bitwiseOR(any_)


def cells(fps: DataFrame, groups: int, distance: int = DISTANCE) -> DataFrame:
    """(cell, fp): the cells of each fingerprint, one for each choice of groups - distance groups."""
    points = fps.select("fp", embedded(F.col("fp")).alias("point"))
    edges = [2 * (SEGMENTS * k // groups) for k in range(groups + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(t), F.col("point").bitwiseAND(F.lit(_signed(sum(some))))) for t, some in enumerate(combinations(masks, groups - distance))]
    return points.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def forest(group: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) that join what is linked within each group; group is sorted. At most one a row."""
    n, points = len(fps), embedded(fps)
    label = np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            differ = low != high
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(label, high[differ], low[differ])
            while not np.array_equal(label, deeper := label[label]):
                label[:] = deeper

    found, held, at, lag = [], 0, np.arange(n), 1
    while len(at):
        at = at[at + lag < n]
        at = at[group[at] == group[at + lag]]
        near = at[np.bitwise_count(points[at] ^ points[at + lag]) <= distance]  # Manhattan, the lower bound
        near = near[np.bitwise_count((fps[near] ^ fps[near + lag]).view(np.uint64)) <= distance]  # of a signed one, those of its size
        near = near[label[near] != label[near + lag]]
        found.append((near, near + lag))
        held += len(near)
        if held > 1 << 20:
            merge(*(np.concatenate(x) for x in zip(*found)))
            found, held = [], 0
        lag += 1
    if found:
        merge(*(np.concatenate(x) for x in zip(*found)))
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints fps (fp) whose components are those of all links."""
    work = work_dir(fps.sparkSession)
    every = cells(fps, groups_for(fps.count(), distance), distance)
    shared = every.groupBy("cell").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit("block")), blocks).cast("int")
    met = every.join(shared, "cell").select("cell", "fp", blocks.alias("blocks"), own.alias("own"))
    met = met.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = met.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.col("fp"))

    def run(batches):
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(g, f):
            a, b = forest(g, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if len(group) and group[0] != group[-1]:
                cut = int(np.searchsorted(group, group[-1]))
                yield done(group[:cut], fp[:cut])
                group, fp = group[cut:], fp[cut:]
        if len(group):
            yield done(group, fp)

    return written(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint"), f"{work}/links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 lower-case hexadecimal digits. component_id: the smallest id that links of at most
    distance differing bits reach, the row's own included. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows get a row each. A null id is never the smallest; a component of null
    ids alone has a null component_id. No rows give no rows; other columns are ignored.
    """
    work = work_dir(docs.sparkSession)
    marked = written(fingerprints(docs, id_col, text_col, shingle), f"{work}/fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), f"{work}/distinct")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
