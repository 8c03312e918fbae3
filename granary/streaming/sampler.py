"""The sampler's round: what has arrived is thinned to minutes, rolled up by day, and old rows are let go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from granary.operators import capacity as C
from granary.sources.stages import stage


def _table(like: DataFrame, folder: str, schema: str) -> DataFrame:
    try:
        return like.sparkSession.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.sparkSession.createDataFrame([], schema)


def _replace(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def sampling_round(arrived: DataFrame, folder: str, now, raw_days: int, daily_days: int) -> None:
    """One round over samples that have arrived: ``folder``/raw and ``folder``/daily, partitioned by day, are brought up to date.

    Only days that samples arrived for are read and written; a round that is repeated gives the same tables.
    Days below both retentions are read past (:func:`raw_table`, :func:`daily_table`) and removed with the round.
    """
    day = F.to_date("sample_time")
    samples = stage(C.first_per_minute(arrived).withColumn("day", day), "arrived")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema)
    days = samples.select("day").distinct()
    held = _table(samples, f"{folder}/raw", kind).join(F.broadcast(days), "day", "left_semi")  # a day a row
    merged = stage(C.first_per_minute(held.select(*samples.columns).unionByName(samples)).withColumn("day", day), "merged")
    rollup = stage(C.daily_rollup(merged), "daily")
    _replace(C.retain_raw(merged, now, raw_days), f"{folder}/raw")
    _replace(C.retain_daily(rollup, now, daily_days), f"{folder}/daily")
    raw_first, daily_first = (arrived.sparkSession.sql(f"SELECT date_sub(to_date(TIMESTAMP '{now}'), {n})").first()[0] for n in (raw_days, daily_days))
    _drop_days(arrived, f"{folder}/raw", raw_first)
    _drop_days(arrived, f"{folder}/daily", daily_first)


def _drop_days(like: DataFrame, folder: str, first) -> None:
    """Removes the partitions of days before ``first``: whole folders, nothing is rewritten."""
    spark = like.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            if name.startswith("day=") and name[4:] < str(first):
                fs.delete(x.getPath(), True)


def raw_table(spark, folder: str, now, raw_days: int) -> DataFrame:
    """The samples that the retention keeps, to the minute."""
    return C.retain_raw(spark.read.parquet(f"{folder}/raw"), now, raw_days)


def daily_table(spark, folder: str, now, daily_days: int) -> DataFrame:
    return C.retain_daily(spark.read.parquet(f"{folder}/daily"), now, daily_days)


def run_sampler(samples: DataFrame, folder: str, checkpoint: str, raw_days: int, daily_days: int, *, every: str | None = "15 minutes", now=None) -> StreamingQuery:
    """A round for each micro-batch of a stream of samples; ``now`` defaults to the time of the round."""

    def one(batch: DataFrame, epoch: int) -> None:
        at = now or batch.sparkSession.sql("SELECT date_format(now(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
        sampling_round(batch, folder, at, raw_days, daily_days)

    writer = samples.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
