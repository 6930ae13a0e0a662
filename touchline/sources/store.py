"""Stored tables as versioned folders: a writer never touches what a reader may be reading.

A table is a folder of numbered versions; the current one is the highest that was written whole. A write
makes the next. Spark has no UPDATE or DELETE on files, so each kind of load is an anti-join and a union.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only a session without that setting, as in tests, gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="touchline-")
    return f"{base.rstrip('/')}/touchline-{uuid.uuid4().hex}"


def landed(rows: DataFrame) -> DataFrame:
    """rows written once to the shared folder and read from there: what reads them more than once makes them once,
    and a lost executor costs a read, not a fit."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        whole = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in whole if n[:1] == "v" and n[1:].isdigit())

    def exists(self, table: str) -> bool:
        """Whether an optional table is there; readers ask before they plan a join."""
        return bool(self._versions(table))

    def read(self, table: str, schema: str) -> DataFrame:
        """The current version, empty where there is none."""
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{versions[-1]}")

    def replace(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """A new version of exactly rows. Two writers that make the same version number fail, not mix."""
        version = (self._versions(table) or [0])[-1] + 1
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/v{version}")

    def upsert(self, table: str, rows: DataFrame, schema: str, keys: tuple[str, ...]) -> None:
        """rows instead of all stored rows with one of their keys. Loading twice is loading once."""
        stored = self.read(table, schema)
        columns = stored.columns
        incoming = rows.select(columns)
        gone = incoming.select(*keys).distinct()
        on = [stored[k].eqNullSafe(gone[k]) for k in keys]
        self.replace(table, stored.join(gone, on, "left_anti").unionByName(incoming))

    def append(self, table: str, rows: DataFrame, schema: str) -> None:
        """rows as further files of the current version: what is stored is neither read nor written again. Who reads
        at the same time sees all of rows or none, as the files are moved in when the job is committed."""
        columns = self.spark.createDataFrame([], schema).columns
        versions = self._versions(table)
        if not versions:
            return self.replace(table, rows.select(columns))
        rows.select(columns).write.mode("append").parquet(f"{self.root}/{table}/v{versions[-1]}")

    def scoped_replace(self, table: str, rows: DataFrame, schema: str, scope: tuple[str, ...]) -> None:
        """rows instead of all stored rows in a scope that rows have; upsert under another name for its meaning."""
        self.upsert(table, rows, schema, scope)

    def where(self, table: str, schema: str, **values) -> DataFrame:
        """The rows with these values; None asks for nothing, a list for any of it."""
        out = self.read(table, schema)
        for name, value in values.items():
            if value is not None:
                out = out.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
        return out


def export_csv(rows: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Rows in a total order as CSV; columns that CSV can't hold are left out."""
    flat = [f.name for f in rows.schema if f.dataType.typeName() not in ("map", "array", "struct")]
    rows.select(flat).orderBy(*order, *[c for c in flat if c not in order]).write.mode("overwrite").csv(path, header=True)


def import_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def import_rows(store: Store, path: str, table: str, schema: str, keys: tuple[str, ...]) -> None:
    """An exported file into its table, by the upsert that loads it otherwise."""
    store.upsert(table, import_csv(store.spark, path, schema), schema, keys)


def require_fresh(fixtures: DataFrame, as_of, pulled_at=None, hours: int = 72) -> None:
    """Raises if the fixtures are stale(), before anything is priced from them."""
    row = stale(fixtures, as_of, pulled_at, hours).first()
    if row["stale"]:
        raise ValueError(f"fixtures are stale: the last is of {row['latest']}, asked for {as_of}")


def stale(fixtures: DataFrame, as_of, pulled_at=None, hours: int = 72) -> DataFrame:
    """(latest, stale): whether the last fixture lies before as_of, or the file was pulled too long before."""
    late = F.max("fixture_date") < F.lit(as_of).cast("date")
    old = F.lit(False) if pulled_at is None else (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.lit(pulled_at).cast("timestamp")) > hours * 3600)
    return fixtures.agg(F.max("fixture_date").alias("latest"), (F.coalesce(late, F.lit(True)) | old).alias("stale"))
