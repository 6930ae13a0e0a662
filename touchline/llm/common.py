"""Shared pieces: the working folder, written intermediate tables, word spans and rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at together; its arrays take up to a hundred times that.
CHUNK_CHARS = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that all executors share (spark.checkpoint.dir).

    Only a session without that setting, as in tests, gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_already.get() if set_already.isDefined() else tempfile.mkdtemp(prefix="touchline-")
    return f"{base.rstrip('/')}/touchline-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read again: its lineage is cut, and lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are written and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(batches: Iterator[pa.RecordBatch], text: int = 1, chunk: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about chunk bytes of text, or one row. After the last, what the worker
    has freed goes back to the machine: a worker outlives its task, and would hold on to it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // chunk
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    hand_back()


#: A key is hot if it has more than one row in so many.
HOT = 1000


def looked_up(rows: DataFrame, table: DataFrame, copies: DataFrame, key: str, n: int) -> DataFrame:
    """rows with the columns of the one row of table that has their key. copies (key, copies) tells how many of the n
    rows have each. Rows without a match are left out.

    The rows of a hot key are dealt out in parts, and its row of table goes to each. As copies add up to n, fewer
    than HOT keys are hot: only these are broadcast. rows must come from files, so that a task that is done again
    deals alike.
    """
    parts = F.least(F.col("copies"), F.ceil(F.col("copies") * HOT / max(n, 1))).cast("int")
    hot = F.broadcast(copies.where(F.col("copies") * HOT > n).select(key, parts.alias("_parts")).where("_parts > 1"))
    of = F.coalesce("_parts", F.lit(1))
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).join(hot, key, "left").withColumn("_part", F.pmod("_at", of).cast("int"))
    every = table.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1)))
    return dealt.drop("_at", "_parts").join(every.drop("_parts"), [key, "_part"]).drop("_part")


def hand_back() -> None:
    """Return freed memory to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of many texts at once, with hashes of any run of consecutive words.

    doc: the text of each word. A run's hash depends on the words alone, not on the white space or
    the text that holds it: each distinct word is hashed by XXH64, and hashes of neighbouring runs are
    joined and mixed, doubling their length, so that no pattern of letters or words cancels out.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]  # bytes.split() knows exactly these six white-space bytes
        self.split = split
        self.counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.doc = np.repeat(np.arange(len(split)), self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.flat = [w for words in split for w in words]
        self.n = len(self.flat)
        self._coded = None
        self._runs: dict[tuple[int, int], np.ndarray] = {}

    def _double(self, k: int, salt: int) -> np.ndarray:
        """Hashes of the k words from each position; k is a power of two. Beyond the last word there are none."""
        if (k, salt) not in self._runs:
            if k == 1:
                from xxhash import xxh64_intdigest

                if self._coded is None:
                    coded = pa.array(self.flat, pa.binary()).dictionary_encode()
                    self._coded = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                at, distinct = self._coded
                self._runs[k, salt] = np.fromiter((xxh64_intdigest(w, salt) for w in distinct), dtype=np.uint64, count=len(distinct))[at]
            else:
                half = self._double(k // 2, salt)
                self._runs[k, salt] = joined(half[: max(len(half) - k // 2, 0)], half[k // 2 :])
        return self._runs[k, salt]

    def runs(self, k: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of the k words from each position in at; salts give independent hashes."""
        out, begin = None, 0
        if not len(at):
            return np.zeros(0, np.uint64)
        for bit in reversed(range(k.bit_length())):
            if k >> bit & 1:
                part = self._double(1 << bit, salt)[at + begin]
                out, begin = part if out is None else joined(out, part), begin + (1 << bit)
        return out

    def digests(self, k: int, at: np.ndarray, size: int) -> bytes:
        """BLAKE2b digests of size bytes of the k words from each position in at, space-joined, one after another."""
        lengths = np.fromiter(map(len, self.flat), dtype=np.int64, count=self.n)
        ends = np.cumsum(lengths + 1)
        raw = memoryview(b" ".join(self.flat))
        starts, stops = (ends - lengths - 1)[at].tolist(), (ends - 1)[at + k - 1].tolist()
        return b"".join([blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(starts, stops)])

    def whole(self, k: int) -> np.ndarray:
        """Positions from which k consecutive words lie in one text."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(self.n)
        return np.flatnonzero(room >= k)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two runs that follow each other."""
    return mixed(a * _ODD + b)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: all bits of h reach all bits of the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
