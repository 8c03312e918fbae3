"""Capacity series of volumes: minute samples, daily rollups, retention, history reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.expressions import minute_ceil, minute_floor

METRICS = ("used", "total", "free", "available")
_SAMPLE = ["event_id", "total_bytes", "free_bytes", "available_bytes", "used_bytes", "quality"]


def first_per_minute(samples: DataFrame) -> DataFrame:
    """The first sample (lowest event_id) of each volume and minute: a partial aggregation."""
    first = samples.groupBy("volume_id", "sample_time").agg(F.min_by(F.struct(*_SAMPLE), "event_id").alias("s"))
    return first.select("volume_id", "sample_time", "s.*")


def daily_rollup(samples: DataFrame) -> DataFrame:
    """Least, most and last values of each volume and day, compared as numbers, of good samples only. Days without any have no row."""
    ok = samples.filter(F.col("quality") == "ok").withColumn("day", F.to_date("sample_time"))
    aggregates = []
    for m in METRICS:
        c = F.col(f"{m}_bytes")
        aggregates += [F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max"), F.max_by(c, F.struct("sample_time", "event_id")).alias(f"{m}_last")]
    return ok.groupBy("volume_id", "day").agg(*aggregates, F.count(F.lit(1)).alias("sample_count"))


def merge_daily(kept: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rebuilt days replace kept ones; days whose raw samples are gone stay."""
    return kept.join(rebuilt.select("volume_id", "day"), ["volume_id", "day"], "left_anti").unionByName(rebuilt)


def retain_raw(samples: DataFrame, now, days: int) -> DataFrame:
    return samples.filter(F.col("sample_time") >= minute_floor(F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days")))


def retain_daily(daily: DataFrame, now, days: int) -> DataFrame:
    return daily.filter(F.col("day") >= F.date_sub(F.to_date(F.lit(now).cast("timestamp")), int(days)))


def maintain(samples: DataFrame, daily: DataFrame, now, raw_days: int, daily_days: int) -> tuple[DataFrame, DataFrame]:
    """Raw samples and daily rows after one round: the rollup first, then both retentions."""
    merged = merge_daily(daily, daily_rollup(samples))
    return retain_raw(samples, now, raw_days), retain_daily(merged, now, daily_days)


def raw_history(samples: DataFrame, start, end, volume_id: str | None = None, after=None) -> DataFrame:
    """Samples of [start, end), bounds moved up to whole minutes, by volume and minute; ``after`` is the last (volume_id, minute) of the page before."""
    lo, hi = (minute_ceil(F.lit(t).cast("timestamp")) for t in (start, end))
    rows = samples.filter((F.col("sample_time") >= lo) & (F.col("sample_time") < hi))
    if volume_id is not None:
        rows = rows.filter(F.col("volume_id") == volume_id)
    if after is not None:
        volume, minute = F.lit(after[0]), F.lit(after[1]).cast("timestamp")
        rows = rows.filter((F.col("volume_id") > volume) | ((F.col("volume_id") == volume) & (F.col("sample_time") > minute)))
    return rows.orderBy("volume_id", "sample_time")


def daily_history(daily: DataFrame, start, end, volume_id: str | None = None) -> DataFrame:
    """Days from the one that holds start; the day that holds a mid-day end is included."""
    first, last = F.to_date(F.lit(start).cast("timestamp")), F.to_date(F.lit(end).cast("timestamp") - F.expr("interval 1 microsecond"))
    rows = daily.filter((F.col("day") >= first) & (F.col("day") <= last))
    return (rows if volume_id is None else rows.filter(F.col("volume_id") == volume_id)).orderBy("volume_id", "day")


def daily_view(daily: DataFrame) -> DataFrame:
    """Daily rows as a series: a day's value is its last; capacities are decimal strings."""
    return daily.select("volume_id", "day", *(F.col(f"{m}_last").cast("string").alias(f"{m}_bytes") for m in METRICS), "sample_count")


def latest_per_volume(samples: DataFrame) -> DataFrame:
    return samples.groupBy("volume_id").agg(F.max_by(F.struct("sample_time", *_SAMPLE[1:]), "sample_time").alias("s")).select("volume_id", "s.*")


def capacity_total(latest: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Totals over confirmed volumes whose latest sample is good; null if there is none."""
    ok = latest.filter(F.col("quality") == "ok").join(confirmed.select("volume_id").distinct(), "volume_id", "left_semi")
    return ok.agg(*(F.sum(f"{m}_bytes").alias(f"{m}_bytes") for m in ("total", "used", "available")), F.count(F.lit(1)).alias("volumes"))


def unattributed_sources(sources: DataFrame, confirmed: DataFrame) -> DataFrame:
    """How many sources have no confirmed volume; a null volume counts."""
    return sources.join(confirmed.select("volume_id").distinct(), "volume_id", "left_anti").agg(F.count(F.lit(1)).alias("unattributed"))
