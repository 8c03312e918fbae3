"""Capacity series."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import capacity as C
from granary.registry import query
from granary.sources.bindings import SAMPLES_SQL, raw_samples, volume_samples
from granary.sources.stages import new_folder

_DAILY = """, daily AS (SELECT volume_id, CAST(sample_time AS DATE) AS day, """ + ", ".join(f"min({m}_bytes) AS {m}_min, max({m}_bytes) AS {m}_max, arg_max({m}_bytes, (sample_time, event_id)) AS {m}_last" for m in C.METRICS) + """, count(*) AS sample_count
  FROM volume_samples WHERE quality = 'ok' GROUP BY 1, 2) """


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("t1_minute_dedup", SAMPLES_SQL + "SELECT event_id, volume_id, sample_time, used_bytes, quality FROM volume_samples")
def t1(spark, sf):
    return _ntz(volume_samples(spark, sf).select("event_id", "volume_id", "sample_time", "used_bytes", "quality"), "sample_time")


@query("t2_daily_rollup", SAMPLES_SQL + _DAILY + "SELECT * FROM daily")
def t2(spark, sf):
    return C.daily_rollup(volume_samples(spark, sf))


@query("t3_incremental_merge", SAMPLES_SQL + _DAILY + "SELECT volume_id, day, CASE WHEN day(day) % 2 = 0 THEN -1 ELSE used_last END::DECIMAL(20, 0) AS used_last, sample_count FROM daily")
def t3(spark, sf):
    daily = C.daily_rollup(volume_samples(spark, sf)).select("volume_id", "day", "used_last", "sample_count")
    kept = daily.withColumn("used_last", F.lit(-1).cast("decimal(20,0)"))
    return C.merge_daily(kept, daily.filter(F.dayofmonth("day") % 2 == 1))


@query("t4_raw_retention", SAMPLES_SQL + "SELECT volume_id, count(*) AS n FROM volume_samples WHERE sample_time >= date_trunc('minute', TIMESTAMP '2024-01-20 12:34:56' - INTERVAL 5 DAY) GROUP BY 1")
def t4(spark, sf):
    return C.retain_raw(volume_samples(spark, sf), "2024-01-20 12:34:56", 5).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))


@query("t4_daily_retention", SAMPLES_SQL + _DAILY + "SELECT volume_id, day FROM daily WHERE day >= DATE '2024-01-20' - 10")
def t4_daily(spark, sf):
    return C.retain_daily(C.daily_rollup(volume_samples(spark, sf)), "2024-01-20 12:34:56", 10).select("volume_id", "day")


@query("t5_raw_history", SAMPLES_SQL + "SELECT volume_id, sample_time, used_bytes FROM volume_samples WHERE sample_time >= TIMESTAMP '2024-01-03 00:01:00' AND sample_time < TIMESTAMP '2024-01-04 10:00:00'")
def t5(spark, sf):
    return _ntz(C.raw_history(volume_samples(spark, sf), "2024-01-03 00:00:30", "2024-01-04 10:00:00").select("volume_id", "sample_time", "used_bytes"), "sample_time")


@query("t5_daily_history", SAMPLES_SQL + _DAILY + "SELECT volume_id, day, used_last FROM daily WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-08'")
def t5_daily(spark, sf):
    return C.daily_history(C.daily_rollup(volume_samples(spark, sf)), "2024-01-03 05:00:00", "2024-01-08 12:00:00").select("volume_id", "day", "used_last")


@query("t8_daily_view", SAMPLES_SQL + _DAILY + "SELECT volume_id, day, " + ", ".join(f"{m}_last::VARCHAR AS {m}_bytes" for m in C.METRICS) + ", sample_count FROM daily")
def t8(spark, sf):
    return C.daily_view(C.daily_rollup(volume_samples(spark, sf)))


@query("j11_latest_sample", SAMPLES_SQL + "SELECT volume_id, max(sample_time) AS sample_time, arg_max(used_bytes, sample_time) AS used_bytes, arg_max(quality, sample_time) AS quality FROM volume_samples GROUP BY 1")
def j11(spark, sf):
    return _ntz(C.latest_per_volume(volume_samples(spark, sf)).select("volume_id", "sample_time", "used_bytes", "quality"), "sample_time")


@query("a16_capacity_total", SAMPLES_SQL + """, latest AS (SELECT * FROM volume_samples WHERE quality = 'ok' QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY sample_time DESC) = 1)
SELECT sum(total_bytes)::DECIMAL(30, 0) AS total_bytes, sum(used_bytes)::DECIMAL(30, 0) AS used_bytes, sum(available_bytes)::DECIMAL(30, 0) AS available_bytes, count(*) AS volumes FROM latest WHERE volume_id <> 'view'""")
def a16(spark, sf):
    good = volume_samples(spark, sf).filter("quality = 'ok'")
    confirmed = good.select("volume_id").distinct().filter("volume_id <> 'view'")
    return C.capacity_total(C.latest_per_volume(good), confirmed)


@query("f14_capacity_check", SAMPLES_SQL + "SELECT volume_id, count(*) FILTER (free_bytes <= total_bytes AND available_bytes <= free_bytes) AS good, count(*) AS n FROM volume_samples GROUP BY 1")
def f14(spark, sf):
    from granary.functions.expressions import capacity_is_consistent

    ok = capacity_is_consistent(F.col("total_bytes"), F.col("free_bytes"), F.col("available_bytes"))
    return volume_samples(spark, sf).groupBy("volume_id").agg(F.count_if(ok).alias("good"), F.count(F.lit(1)).alias("n"))


@query("f24_usage_percent", SAMPLES_SQL + "SELECT event_id, floor(used_bytes * 10000 / total_bytes) / 100 AS percent FROM volume_samples")
def f24(spark, sf):
    from granary.functions.expressions import usage_percent

    return volume_samples(spark, sf).select("event_id", usage_percent("used_bytes", "total_bytes").alias("percent"))


def _changelog(spark, sf):
    """First samples of minutes by a stream with state of its own, over the events' files into a table."""
    from granary.streaming import capacity as S
    from granary.streaming import keyed

    folder, checkpoint = new_folder(spark, "first-samples"), new_folder(spark, "stream")
    keyed.to_table(keyed.first_samples(S.event_stream(spark, sf, "events.parquet")), folder, checkpoint).awaitTermination()
    return C.first_per_minute(spark.read.parquet(folder))


@query("t1_keyed_stream", SAMPLES_SQL + "SELECT event_id, volume_id, sample_time, used_bytes, quality FROM volume_samples")
def t1_keyed(spark, sf):
    return _ntz(_changelog(spark, sf).select("event_id", "volume_id", "sample_time", "used_bytes", "quality"), "sample_time")


@query("t2_streaming_rollup", SAMPLES_SQL + _DAILY + "SELECT volume_id, day, used_min, used_max, used_last, sample_count FROM daily")
def t2_streaming(spark, sf):
    """The same rollup over what the stream has written."""
    return C.daily_rollup(_changelog(spark, sf)).select("volume_id", "day", "used_min", "used_max", "used_last", "sample_count")


@query("e1_event_log_stream", "SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events")
def e1_stream(spark, sf):
    """Events of a job numbered as they arrive."""
    from granary.streaming import capacity as S
    from granary.streaming import keyed

    events = spark.readStream.schema(S.EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf).select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("type"))
    folder = new_folder(spark, "event-log")
    keyed.to_table(keyed.event_log(events), folder, new_folder(spark, "stream"), mode="append").awaitTermination()
    return spark.read.parquet(folder).select("job_id", "event_id", "sequence")


_ROUNDS = ("2024-01-12 00:00:00", "2024-01-20 12:34:00")


@query("t7_sampler_rounds", SAMPLES_SQL.replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{_ROUNDS[1]}')") + _DAILY + """
SELECT 'raw' AS kind, volume_id, sample_time::DATE AS day, count(*) AS n, sum(used_bytes)::DECIMAL(30, 0) AS used FROM volume_samples WHERE sample_time >= TIMESTAMP '2024-01-15 12:34:00' GROUP BY 1, 2, 3
UNION ALL SELECT 'daily', volume_id, day, sample_count, used_last::DECIMAL(30, 0) FROM daily WHERE day >= DATE '2024-01-10'""")
def t7(spark, sf):
    """Two rounds of the sampler: rows kept by day after the second."""
    from granary.streaming import sampler as P

    samples, folder, start = raw_samples(spark, sf), new_folder(spark, "sampler"), "2000-01-01 00:00:00"
    for end in _ROUNDS:
        P.sampling_round(samples.filter((F.col("ts") >= start) & (F.col("ts") < end)), folder, end, 5, 10)
        start = end
    raw = P.raw_table(spark, folder, end, 5).groupBy(F.lit("raw").alias("kind"), "volume_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("used_bytes").cast("decimal(30,0)").alias("used"))
    daily = P.daily_table(spark, folder, end, 10).select(F.lit("daily").alias("kind"), "volume_id", "day", F.col("sample_count").alias("n"), F.col("used_last").cast("decimal(30,0)").alias("used"))
    return raw.unionByName(daily)
