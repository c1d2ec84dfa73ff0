"""Streaming forms of ingestion: new corpus rows by micro-batch, and daily stage metrics with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvale.sources.stores import upsert


def read_files(spark: SparkSession, folder: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def upsert_stream(rows: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch makes the next version of a keyed table below target; a repeated batch makes the same version again."""
    spark = rows.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        before = f"{target}/version={epoch - 1}"
        merged = batch.dropDuplicates(key) if epoch == 0 else upsert(spark.read.parquet(before), batch, key)
        merged.write.mode("overwrite").parquet(f"{target}/version={epoch}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_metrics(snapshots: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(day, status, runs, mean_ms) of snapshots (snapshot_at, job_status, total_ms) by tumbling window; rows later than late are left out."""
    rows = snapshots.withWatermark("snapshot_at", late) if snapshots.isStreaming else snapshots
    grouped = rows.groupBy(F.window("snapshot_at", width).alias("w"), F.col("job_status").alias("status"))
    return grouped.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("total_ms"), 6).alias("mean_ms")).select(F.col("w.start").alias("day"), "status", "runs", "mean_ms")
