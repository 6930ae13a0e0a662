"""Packing documents into token windows by multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path
from .common import in_chunks, texts_of

WINDOW = 1024
#: Longest piece that differencing places; what is left of a document beyond whole windows is cut to it.
PIECE = 128
#: Pieces that are packed together; bounds the memory and time of one packing, not the corpus.
GROUP = 2048
TOKENIZER = "byte_bpe_50k.json"
SEPARATOR = 0

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each size and the sum of each window, by the largest-differencing method for many ways.

    A partial partition is the descending sums of its windows that hold anything; the two with the largest
    spread are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)  # inner nodes join two sets of sizes
    nodes, heap = n, []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, np.array([size]), np.array([i])))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, a_set = heapq.heappop(heap)
        _, _, b, b_set = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:  # the smallest `over` windows of each side meet, fullest with emptiest
            x, y = len(a) - over, len(b) - over
            both = np.arange(nodes, nodes + over)
            while nodes + over > len(left):
                left, right = (np.concatenate([z, np.full(len(z), -1)]) for z in (left, right))
            left[both], right[both] = a_set[x:], b_set[y:][::-1]
            nodes += over
            sums = np.concatenate([a[:x], b[:y], a[x:] + b[y:][::-1]])
            sets = np.concatenate([a_set[:x], b_set[:y], both])
        else:
            sums, sets = np.concatenate([a, b]), np.concatenate([a_set, b_set])
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, tie, sums, sets))
    out, totals = np.empty(n, np.int64), np.zeros(windows, np.int64)
    if n:
        _, _, sums, sets = heap[0]
        totals[: len(sums)] = sums
        for w, top in enumerate(sets.tolist()):
            stack = [top]
            while stack:
                k = stack.pop()
                if k < n:
                    out[k] = w
                else:
                    stack += [left[k], right[k]]
    return out, totals


def windows_for(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """The window of each size, none over capacity. Their number starts at the least that could hold all
    and rises by as much as the fullest window was over, until it fits. Sizes over capacity are refused."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a piece is longer than a window")
    total = int(sizes.sum())
    windows = -(-total // capacity)
    while True:
        out, sums = differencing(sizes, windows)
        if sums.max() <= capacity:
            return out
        windows += max(1, int((sums.max() - capacity) * windows / (2 * capacity)))


def _packed(pieces: list[tuple], first: int) -> tuple[pa.RecordBatch | None, int]:
    """Rows of pieces (doc_id, start, doc_tokens, ids); the number of sequences."""
    sizes = np.fromiter((len(p[3]) for p in pieces), dtype=np.int64, count=len(pieces))
    window = windows_for(sizes)
    order = np.argsort(window, kind="stable")
    at, n = window[order], sizes[order]
    ends = np.cumsum(n)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    offset = ends - n - np.repeat((ends - n)[begin], np.diff(np.r_[begin, len(at)]))
    chosen = [pieces[i] for i in order.tolist()]
    return _rows(chosen, first + at, offset), int(window.max()) + 1 if len(window) else 0


def _rows(pieces: list[tuple], sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([len(p[3]) for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64()),
            pa.array([p[3].tobytes() for p in pieces], pa.binary()),
        ],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all rows of docs, packed into sequences of at most WINDOW tokens.

    A document is its token ids and then the separator. Whole windows of it are sequences of their own; its
    rest, cut to PIECE tokens, is packed with the rests of other documents of the same partition of the
    input, GROUP pieces at a time, so nothing is shuffled. ids holds a piece's ids, little-endian unsigned
    32-bit. sequence_id is the partition's number and a count within it.

    A null or empty text is the separator alone. Repeated rows are packed each; a null id stays null; no
    rows give no sequences; other columns are ignored.
    """

    def run(batches):
        encode = encoder(vocabulary_path(tokenizer)).ids
        first, waiting = TaskContext.get().partitionId() << 36, []
        for batch in in_chunks(batches):
            texts = [t.decode("utf-8", "replace") for t in texts_of(batch.column(1))]
            whole = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.append(ids, SEPARATOR).astype("<u4")
                n = len(ids)
                full = n - n % WINDOW
                whole += [(doc, s, n, ids[s : s + WINDOW]) for s in range(0, full, WINDOW)]
                waiting += [(doc, s, n, ids[s : min(s + PIECE, n)]) for s in range(full, n, PIECE)]
            if whole:
                yield _rows(whole, first + np.arange(len(whole)), np.zeros(len(whole), np.int64))
                first += len(whole)
            while len(waiting) >= GROUP:
                group, waiting = waiting[:GROUP], waiting[GROUP:]
                rows, n = _packed(group, first)
                first += n
                yield rows
        if waiting:
            yield _packed(waiting, first)[0]

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
