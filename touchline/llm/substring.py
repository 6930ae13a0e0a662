"""Exact repeats across documents: fixed-block anchors, rolling probes, extension to maximal repeats.

Every document is cut into blocks of ANCHOR words that don't overlap, and the blocks are indexed with the
smallest document that holds them. Each run of ANCHOR consecutive words of every document probes the index.
A window of WINDOW words holds a whole block wherever it lies, so of two documents that share a window the
smaller has a block in it, which the larger one hits. A hit is then extended word by word to the windows that
hold it. A window is compared with those around the other documents' hits by a cryptographic digest of its
words, and adjoining windows that repeat make up the maximal repeat.

Both comparisons travel as packed arrays, one row for each bucket of hashes and chunk of text. What a chunk can
answer itself, because a smaller document in it has the same block or window, it answers: however many copies a
passage has, a chunk sends it on once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, in_chunks, mixed, release, shuffle_partitions, texts_of, work_dir, written

WINDOW = 50
ANCHOR = (WINDOW + 1) // 2
#: Bytes of text whose own copies are answered at once; the larger, the less of a frequent passage travels.
CHUNK = 1 << 21

_PACKED = "bucket int, kind int, docs binary, counts binary, keys binary, at binary"
_KEY = np.dtype([("low", "<u4"), ("high", "<u8")])
#: A window's digest: the key it is compared by, and what its bucket is drawn from.
_DIGEST = np.dtype([("low", "<u4"), ("high", "<u8"), ("bucket", "<u4")])


def _bucketed(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, keeping that of equal ones, and each bucket's bounds."""
    small = bucket.astype(np.uint16) if n <= 1 << 16 else bucket
    return np.argsort(small, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def _pack(kind: int, n: int, bucket, doc, docs: np.ndarray, keys, at=None) -> list[tuple]:
    """Rows of _PACKED; doc gives each key's row of docs, in order."""
    order, cut = _bucketed(bucket, n)
    doc, keys = doc[order], keys[order]
    at = at[order].astype("<u4") if at is not None else None
    rows = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        part = slice(cut[b], cut[b + 1])
        present, counts = np.unique(doc[part], return_counts=True) if len(docs) > 1 else (np.zeros(1, int), np.array([cut[b + 1] - cut[b]]))
        rows.append((b, kind, docs[present].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), keys[part].tobytes(), b"" if at is None else at[part].tobytes()))
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["bucket", "kind", "docs", "counts", "keys", "at"])


def _rows(batches, width: int):
    """The rows of _PACKED as tuples of arrays; a document is named by so many numbers."""
    for batch in batches:
        for bucket, kind, docs, counts, keys, at in zip(*(c.to_pylist() for c in batch.columns)):
            yield bucket, kind, np.frombuffer(docs, "<i8").reshape(-1, width), np.frombuffer(counts, "<u4"), keys, np.frombuffer(at, "<u4")


def _anchors(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs of ANCHOR words, and their codes: bucket and 32 bits of hash."""
    at = words.whole(ANCHOR)
    h = words.runs(ANCHOR, at)
    return at, ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _groups(keys: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, then ids; the bounds of equal keys in it; and each group's number, in that order."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.concatenate([[0], np.flatnonzero(new)]), np.cumsum(new)


def _answered(code: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a chunk by what is to be done with them: blocks to index and probes to send, one of each for a
    document and code, and rows whose hit the chunk knows."""
    order, first, group = _groups((code,), ids)
    i, b = ids[order], block[order]
    top = np.iinfo(np.int64).max
    least = np.minimum.reduceat(np.where(b, i, top), first)[group]  # the smallest document with the block
    met = i > least
    crowd = np.zeros(len(first), bool)
    crowd[group[met]] = True
    again = np.zeros(len(order), bool)
    again[1:] = (group[1:] == group[:-1]) & (i[1:] == i[:-1])
    one = ~again  # a document's other rows of the code add nothing
    holds = np.zeros(len(order), bool)
    at = np.flatnonzero(one)
    holds[at] = np.logical_or.reduceat(b, at) & (i[at] == least[at])
    return np.sort(order[holds]), np.sort(order[one & ~met]), np.sort(order[one & (met | (crowd[group] & (i == least)))])


def hits(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, code): the anchors of a document (id, mark, text) that a smaller one has as a block, and the
    smallest document's own anchors that another hits."""

    def probe(batches):
        for batch in in_chunks(batches, 2, CHUNK):
            ids = batch.column(0).to_numpy().reshape(-1, 1)
            words = Words(texts_of(batch.column(2)))
            at, code = _anchors(words, buckets)
            if not len(at):
                continue
            bucket, low, doc = code >> 32, (code & 0xFFFFFFFF).astype("<u4"), words.doc[at]
            block = (at - words.first[doc]) % ANCHOR == 0
            index, probe_, known = _answered(code, ids[doc, 0], block)
            rows = _pack(0, buckets, bucket[index], doc[index], ids, low[index]) + _pack(1, buckets, bucket[probe_], doc[probe_], ids, low[probe_])
            yield _batch(rows + _pack(2, buckets, bucket[known], doc[known], ids, low[known]))

    def meet(batches):
        def found(doc, low, bucket):
            pairs = np.unique(np.stack([doc, low.astype(np.int64) | bucket << 32], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "code"])

        now, index, known, least, hit = None, [], None, None, None
        for bucket, kind, docs, counts, keys, _ in _rows(batches, 1):
            if bucket != now:
                if hit is not None and hit.any():
                    yield found(least[hit], known[hit], now)
                now, index, known, hit = bucket, [], None, None
            low, doc = np.frombuffer(keys, "<u4"), np.repeat(docs[:, 0], counts)
            if kind == 0:
                index.append((low, doc))
                continue
            if kind == 2:
                yield found(doc, low, bucket)
                continue
            if known is None:
                if not index:
                    continue
                low_, doc_ = (np.concatenate(x) for x in zip(*index))
                order = np.argsort(low_, kind="stable")
                known, first = np.unique(low_[order], return_index=True)
                least, hit, index = np.minimum.reduceat(doc_[order], first), np.zeros(len(known), bool), []
            j = np.minimum(np.searchsorted(known, low), len(known) - 1)
            met = (known[j] == low) & (least[j] < doc)
            hit[j[met]] = True
            if met.any():
                yield found(doc[met], low[met], bucket)
        if hit is not None and hit.any():
            yield found(least[hit], known[hit], now)

    return docs.mapInArrow(probe, _PACKED).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(meet, "id bigint, code bigint")


def _unit(docs: np.ndarray, units: int) -> np.ndarray:
    """Which of so many units of the corpus a document (id, mark) belongs to."""
    return ((mixed(docs[:, 0].view(np.uint64)) ^ docs[:, 1].view(np.uint64)) % np.uint64(units)).astype(np.int64)


def repeats(docs: DataFrame, buckets: int) -> DataFrame:
    """_PACKED: the starts of windows of the documents (id, mark, text, codes) around their hits that a smaller
    document has too. A row is what one bucket of keys has found for one unit of the corpus."""

    def windows(batches):
        for batch in in_chunks(batches, 2, CHUNK):
            ids = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            words = Words(texts_of(batch.column(2)))
            at, code = _anchors(words, buckets)
            hit = np.zeros(words.n + 1, np.int64)
            bounds = np.searchsorted(at, words.first)
            for k, codes in enumerate(batch.column(3)):
                part = slice(bounds[k], bounds[k + 1])
                hit[at[part]] = np.isin(code[part], codes.values.to_numpy())
            reach = np.concatenate([[0], np.cumsum(hit)])
            full = words.whole(WINDOW)
            full = full[reach[full + WINDOW - ANCHOR + 1] > reach[full]]
            if len(full):
                digests = np.frombuffer(words.digests(WINDOW, full, _DIGEST.itemsize), _DIGEST)
                keys = np.empty(len(full), _KEY)
                keys["high"], keys["low"] = digests["high"], digests["low"]
                doc = words.doc[full]
                order, first, group = _groups((digests["low"], digests["high"]), ids[doc, 0])
                known = np.zeros(len(full), bool)
                known[order] = ids[doc[order], 0] > ids[doc[order[first]], 0][group]  # a smaller one of the chunk has it
                ask, place = ~known, full - words.first[doc]
                rows = _pack(0, buckets, (digests["bucket"][ask] % buckets).astype(np.int64), doc[ask], ids, keys[ask], place[ask])
                yield _batch(rows + _pack(1, buckets, _unit(ids, buckets)[doc[known]], doc[known], ids, np.zeros(int(known.sum()), "V0"), place[known]))

    def compare(batches):
        def done(parts):
            docs, keys, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((keys["low"], keys["high"]))
            docs, keys, at = docs[order], keys[order], at[order]
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1])])
            least = np.repeat(np.minimum.reduceat(docs[:, 0], first), np.diff(np.r_[first, len(keys)]))
            again = docs[:, 0] > least
            docs, at = docs[again], at[again]
            unit = _unit(docs, buckets)
            order = np.lexsort((at, docs[:, 1], docs[:, 0], unit))
            docs, at, unit = docs[order], at[order], unit[order]
            first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]).any(axis=1)]) if len(docs) else np.zeros(0, int)
            return _batch(_pack(0, buckets, unit, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(docs)])), docs[first], np.zeros(len(at), "V0"), at)) if len(docs) else None

        now, parts = None, []
        for bucket, kind, docs, counts, keys, at in _rows(batches, 2):
            if kind == 1:  # found already; bucket is the unit
                yield _batch([(bucket, 0, docs.tobytes(), counts.tobytes(), b"", at.tobytes())])
                continue
            if bucket != now and parts:
                if (out := done(parts)) is not None:
                    yield out
                parts = []
            now = bucket
            parts.append((np.repeat(docs, counts, axis=0), np.frombuffer(keys, _KEY), at))
        if parts and (out := done(parts)) is not None:
            yield out

    return docs.mapInArrow(windows, _PACKED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, _PACKED)


def _without(docs: DataFrame, found: DataFrame, units: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of documents (id, mark, text) by the starts found (_PACKED).

    Both meet by unit: a unit's starts come first in the sorted partition and are held while its documents
    stream by.
    """

    def numbered(batches):
        for batch in batches:
            ids = np.stack([batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_unit(ids, units).astype(np.int32)), *batch.columns], ["unit", "id", "mark", "text"])

    texts = docs.select("id", "mark", "text").mapInArrow(numbered, "unit int, id bigint, mark bigint, text string")
    none = F.lit(None)
    texts = texts.select("unit", F.lit(1).alias("kind"), "id", "mark", "text", none.cast("binary").alias("docs"), none.cast("binary").alias("counts"), none.cast("binary").alias("at"))
    starts = found.select(F.col("bucket").alias("unit"), F.lit(0).alias("kind"), none.cast("bigint").alias("id"), none.cast("bigint").alias("mark"), none.cast("string").alias("text"), "docs", "counts", "at")

    def run(batches):
        now, gone = None, {}
        for batch in in_chunks(batches, 4, CHUNK):
            ids, n, removed, kept = [], [], [], []
            for unit, kind, i, mark, text, docs_, counts, at in zip(*(batch.column(k).to_pylist() if k != 4 else texts_of(batch.column(4)) for k in range(8))):
                if unit != now:
                    now, gone = unit, {}
                if kind == 0:
                    names, cuts = np.frombuffer(docs_, "<i8").reshape(-1, 2).tolist(), np.cumsum(np.frombuffer(counts, "<u4"))[:-1]
                    for name, part in zip(names, np.split(np.frombuffer(at, "<u4"), cuts)):
                        gone.setdefault(tuple(name), []).append(part)
                    continue
                words = text.split()
                n.append(len(words))
                found_ = gone.get((i, mark)) if i is not None else None
                if found_:
                    edge = np.zeros(len(words) + 1, np.int64)
                    first = np.unique(np.concatenate(found_)).astype(np.int64)
                    edge[first] += 1
                    edge[first + WINDOW] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                ids.append(i)
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return texts.unionByName(starts).repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row of docs: the words that no repeated window covers.

    A window repeats if its WINDOW words also start in a row with a smaller id; rows of one id don't remove
    each other's words. A null text has no words. A row with a null id keeps all and removes nothing. No rows
    give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    work, buckets = work_dir(spark), shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).cast("string").alias("text"))
    named = rows.where("id is not null")
    met = written(hits(named, buckets).groupBy("id").agg(F.collect_set("code").alias("codes")), f"{work}/hits")
    release(spark)
    again = written(repeats(named.join(met, "id").select("id", "mark", "text", "codes"), buckets), f"{work}/repeats")
    release(spark)
    out = _without(rows, again, buckets)
    return out.withColumnRenamed("id", id_col)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM t WHERE len(w) >= 50),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS k FROM windows),
least AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM keyed JOIN least USING (k) WHERE first < doc_id),
spread AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM spread s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.pos = s.pos) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
