"""WARC fixity: hash trees over records and ordered offset ranges, and an audit of two replicas.

A file's records have offsets. Leaves are the records' digests; above them stand ranges of RANGE bytes of
offset, whose hash covers the offsets and digests of the records that begin there, in order; each further
level joins FANOUT neighbouring ranges, up to one root for a file. Two replicas are compared by their roots,
and only below nodes that differ are the next level's nodes compared. In the ranges that differ, records meet
by their ids and digests, not their offsets: a record that has only moved, as all do behind one whose length
changed, is sound.

A replica is dealt by file once. All levels of its trees, the join of the roots and the descent keep that
dealing, so an audit has three shuffles whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import work_dir, written

RANGE = 1 << 16
FANOUT = 16
#: Pages of one file of the archive that a table of pages is laid out as.
FILE_PAGES = 512


def record(url: Column, page_id: Column, payload: Column) -> Column:
    """The bytes of a resource record; nulls are empty."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    head = F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """(page_id, file, offset, length, digest) of pages (page_id, url, html) laid out in files by page_id.

    html may be text or bytes; null is empty. In a file, records stand by page_id, then digest; repeated rows
    are records of their own. Null ids are laid out together in files by digest. No rows give no rows; other
    columns are ignored.
    """
    raw = record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("digest"))
    number = F.floor(F.col("page_id") / file_pages)
    file = F.coalesce(F.concat(F.lit("pages-"), number.cast("string")), F.concat(F.lit("unnamed-"), F.substring("digest", 1, 4)))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def depth(*replicas: DataFrame) -> int:
    """How many levels of ranges reach one root in every file of the replicas."""
    last = max((r.agg(F.max(F.floor(F.col("offset") / RANGE))).first()[0] or 0) for r in replicas)
    k = 1
    while last > 0:
        last, k = last // FANOUT, k + 1
    return k


def trees(records: DataFrame, levels: int | None = None) -> DataFrame:
    """(file, node, hash, children): the root of each file's tree of records (file, offset, digest).

    children holds the level below, at most FANOUT nodes with children of their own, down to the ranges. A range
    gathers the offsets and digests of at most RANGE bytes' worth of records; a root's row holds its whole tree,
    some 100 bytes for RANGE bytes of records.
    """
    levels = levels or depth(records)
    entries = records.repartition("file").groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(F.array_sort(F.collect_list(F.struct("offset", "digest"))).alias("entries"))
    lines = F.transform("entries", lambda e: F.concat_ws(":", e["offset"].cast("string"), e["digest"]))
    level = entries.select("file", "node", F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))
    for _ in range(1, levels):
        child = F.struct(*[c for c in level.columns if c != "file"])
        up = level.select("file", F.floor(F.col("node") / FANOUT).alias("node"), child.alias("child")).groupBy("file", "node").agg(F.array_sort(F.collect_list("child")).alias("children"))
        lines = F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"]))
        level = up.select("file", "node", F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), "children")
    return level


def differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, node): the ranges in which two replicas (file, offset, digest) differ, found from the roots down."""
    levels = depth(first, second)
    a, b = (trees(r, levels) for r in (first, second))
    sides = lambda df, name: df.select(F.col("file").alias(f"{name}_file"), F.struct(*[c for c in df.columns if c != "file"]).alias(name))
    roots = sides(a, "a").join(sides(b, "b"), F.col("a_file") == F.col("b_file"), "full").where("not (a.hash <=> b.hash)")
    now = roots.select(F.coalesce("a_file", "b_file").alias("file"), F.lit(0).cast("bigint").alias("node"), "a", "b")
    for _ in range(1, levels):
        below = lambda side: F.coalesce(F.col(f"{side}.children"), F.array())
        nodes = F.array_distinct(F.concat(*[F.transform(below(side), lambda c: c["node"]) for side in ("a", "b")]))
        of = lambda side, n: F.get(F.filter(below(side), lambda c: c["node"] == n), F.lit(0))
        pairs = F.transform(nodes, lambda n: F.struct(n.alias("node"), of("a", n).alias("a"), of("b", n).alias("b")))
        now = now.select("file", F.inline(F.filter(pairs, lambda p: ~p["a"]["hash"].eqNullSafe(p["b"]["hash"]))))
    return now.select("file", "node")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, id, offset, digest, other_offset, other_digest) of the records that two replicas (file, id, offset,
    digest) don't share: one row for a record that was changed, lost or added.

    A record that one replica lacks has a null digest and offset there; a file that one lacks differs in all
    records. Records of one file, id and digest are paired in order of offset, then what is left of the same
    file and id; null ids are equal to each other, and replicas without the column id have their offsets for it.
    Equal replicas, and two without records, give no rows.
    """
    first, second = (r if "id" in r.columns else r.withColumn("id", F.col("offset")) for r in (first, second))
    suspects = written(differing(first, second), f"{work_dir(first.sparkSession)}/suspects")
    rows = None
    for side, r in enumerate((first, second)):
        of = r.select("file", "id", "offset", "digest", F.floor(F.col("offset") / RANGE).alias("node"), F.lit(side).alias("side")).join(suspects, ["file", "node"], "left_semi")
        rows = of if rows is None else rows.unionByName(of)
    rows = rows.repartition("file", "id")  # all that follows keeps this dealing
    nth = F.row_number().over(Window.partitionBy("file", "id", "digest", "side").orderBy("offset"))
    met = rows.withColumn("nth", nth).groupBy("file", "id", "digest", "nth").agg(F.count("*").alias("n"), F.min("side").alias("side"), F.min("offset").alias("offset"))
    alone = met.where("n = 1").withColumn("nth", F.row_number().over(Window.partitionBy("file", "id", "side").orderBy("offset", "digest")))
    of = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    out = alone.groupBy("file", "id", "nth").agg(of("offset", 0).alias("offset"), of("digest", 0).alias("digest"), of("offset", 1).alias("other_offset"), of("digest", 1).alias("other_digest"))
    return out.drop("nth")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults: the markup of every page whose id leaves 13 over 97 has its first byte
    turned into a tilde. html becomes bytes; null and empty markup and null ids stay as they are, and a page that
    begins with a tilde stays sound."""
    hit = (F.col("page_id") % 97 == 13) & (F.octet_length("html") > 0)
    raw = F.col("html").cast("binary")
    return pages.withColumn("html", F.when(hit, F.overlay(raw, F.lit("~").cast("binary"), F.lit(1), F.lit(1))).otherwise(raw))


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' archive, with what the audit against a replica with planted faults found."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    work = work_dir(spark)
    mine = written(archive(pages), f"{work}/first")
    theirs = written(archive(damaged(pages)), f"{work}/second")
    named = lambda r: r.select("file", F.col("page_id").alias("id"), "offset", "digest")
    faults = written(audit(named(mine), named(theirs)), f"{work}/faults")
    found = faults.where("offset is not null").select("file", "offset", F.lit(True).alias("corrupt"))
    return mine.join(found, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "digest", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))


ORACLE = """
WITH rows AS (
  SELECT page_id, html,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS raw
  FROM pages
),
hashed AS (SELECT page_id, html, 'pages-' || (page_id // 512) AS file, CAST(strlen(raw) AS BIGINT) AS length, sha256(raw) AS digest FROM rows)
SELECT page_id, file,
  CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset,
  length, digest, page_id % 97 = 13 AND length(html) > 0 AND html[1] <> '~' AS corrupt
FROM hashed
"""
