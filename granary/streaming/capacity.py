"""The capacity series as a stream: minute samples and daily rollups by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.capacity import METRICS
from granary.sources.bindings import samples_of

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Samples from Parquet files as they arrive in a folder."""
    return samples_of(spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def minute_samples(samples: DataFrame, late: str = "1 day") -> DataFrame:
    """One sample for each volume and minute; state goes once the watermark has passed."""
    return samples.withWatermark("sample_time", late).dropDuplicatesWithinWatermark(["volume_id", "sample_time"])


def minute_firsts(samples: DataFrame, late: str = "1 day") -> DataFrame:
    """The lowest event of each volume and minute, whatever order events arrive in."""
    rest = [c for c in samples.columns if c not in ("volume_id", "sample_time", "ts")]
    w = samples.withWatermark("ts", late).groupBy("volume_id", F.window("ts", "1 minute")).agg(F.min_by(F.struct(*rest), "event_id").alias("s"))
    return w.select("volume_id", F.col("window.start").alias("sample_time"), "s.*")


def daily_rollup(samples: DataFrame, late: str = "1 day") -> DataFrame:
    """The daily rollup of a stream of samples, as windows of a day."""
    ok = samples.filter(F.col("quality") == "ok").withWatermark("sample_time", late)
    aggregates = []
    for m in METRICS:
        c = F.col(f"{m}_bytes")
        aggregates += [F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max"), F.max_by(c, F.struct("sample_time", "event_id")).alias(f"{m}_last")]
    days = ok.groupBy("volume_id", F.window("sample_time", "1 day")).agg(*aggregates, F.count(F.lit(1)).alias("sample_count"))
    return days.select("volume_id", F.to_date("window.start").alias("day"), *[c for c in days.columns if c not in ("volume_id", "window")])


def sink_batches(stream: DataFrame, folder: str, checkpoint: str, every: str = "15 minutes"):
    """Daily rows written by micro-batch, the volume-days of each batch overwriting what they had (idempotent)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume_id", "day").parquet(folder)

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
