"""The archive as a stream: pulled prices in, an idempotent merge and windowed counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import archive
from ..sources.store import Store, shared_folder  # noqa: F401

LATE = "7 days"


def sightings(pulls: DataFrame, at: str = "pulled_at", late: str = LATE) -> DataFrame:
    """pulls without repeats of a content hash within the watermark. at must be a timestamp with a zone."""
    return pulls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"])


def weekly(pulls: DataFrame, at: str = "pulled_at", late: str = LATE) -> DataFrame:
    """(start, fixture_key, pulls, mean_price) of tumbling weeks; pulls that come later than the watermark are
    left out."""
    rows = pulls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, "7 days"), "fixture_key").agg(F.count("*").alias("pulls"), F.avg("price").alias("mean_price")).select(F.col("window.start").alias("start"), "fixture_key", "pulls", "mean_price")


def weekly_files(spark: SparkSession, pulls: DataFrame, folder: str, at: str = "pulled_at", late: str = LATE) -> DataFrame:
    """weekly() of all that the stream pulls has now, run to its end and read from files.

    Each batch writes the weeks as they stand to a folder of its own number, so a batch that is delivered again
    writes the same files again; the last is read. The stream's checkpoint lies beside them.
    """
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/weeks/{number}")
        last.append(number)

    run = weekly(pulls, at, late).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], "start timestamp, fixture_key string, pulls bigint, mean_price double")
    return spark.read.parquet(f"{folder}/weeks/{max(last)}")


def merge_into(store: Store, table: str = "fixture_snapshots"):
    """A foreachBatch function. A batch that is delivered again changes nothing: merging is idempotent."""

    def merge(batch: DataFrame, _: int) -> None:
        store.replace(table, archive.merged(store.read(table, schema.SNAPSHOTS), batch))

    return merge
