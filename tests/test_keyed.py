"""Streams with state of their own: shuffled arrivals and restarts give what a batch gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import capacity as C
from granary.sources import bindings
from granary.streaming import keyed, sampler
from granary.streaming import capacity as S


@pytest.fixture
def arrivals(spark, small, tmp_path):
    """Two weeks of events, shuffled over six files."""
    events = spark.read.parquet(f"{small}/events.parquet").filter("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    (tmp_path / "in").mkdir()
    parts = events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(6)))

    def arrive(k):
        parts.filter(F.col("part") == k).drop("part").orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return events, arrive, str(tmp_path / "in")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_first_samples_over_restarts(spark, arrivals, tmp_path):
    events, arrive, folder = arrivals
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for k in range(0, 6, 2):  # each round is a restart from the checkpoint
        arrive(k)
        arrive(k + 1)
        keyed.to_table(keyed.first_samples(S.event_stream(spark, folder, files_per_batch=1), late="60 days", late_ms=60 * 86_400_000), out, checkpoint).awaitTermination()
    columns = ["event_id", "volume_id", "sample_time", "used_bytes", "quality"]
    changes = spark.read.parquet(out)
    assert rows(C.first_per_minute(changes).select(columns)) == rows(C.first_per_minute(bindings.samples_of(events)).select(columns))
    assert changes.count() <= events.count() and changes.select("epoch").distinct().count() >= 6
    # a row passes only if it is lower than all of its minute before it
    w = changes.groupBy("volume_id", "sample_time").agg(F.sort_array(F.collect_list(F.struct("epoch", "event_id"))).alias("seen"))
    assert all([x["event_id"] for x in r["seen"]] == sorted((x["event_id"] for x in r["seen"]), reverse=True) for r in w.collect())


def test_state_goes_with_the_watermark(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def arrive(name, rows):
        df = spark.createDataFrame([(i, start + timedelta(minutes=m), "u", "v", 1.0, "") for i, m in rows], "event_id long, ts timestamp, user string, event_type string, value double, props string")
        df.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = keyed.first_samples(S.event_stream(spark, str(tmp_path / "in")), late="1 hour", late_ms=3_600_000)
        keyed.to_table(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()

    arrive("a", [(50, 0), (51, 1)])
    arrive("b", [(40, 0), (60, 600)])  # ten hours on: the first hour's state may go
    arrive("c", [(10, 1), (9, 599)])  # the first is later than the watermark allows
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [9, 40, 50, 51, 60]
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "least").load()
    assert {r["key"]["hour"] * 60 - int(start.timestamp() // 60) for r in left.collect()} <= {540, 600}


def test_event_log_numbers_without_gaps(spark, tmp_path):
    rng, arrived = random.Random(3), {}
    for batch in range(4):
        rows = [(rng.randrange(5), 1000 * batch + k, "t") for k in range(60)]
        for job, event, _ in rows:
            arrived.setdefault(job, []).append(event)
        rng.shuffle(rows)
        spark.createDataFrame(rows, "job_id long, event_id long, type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id long, event_id long, type string").parquet(str(tmp_path / "in"))
        keyed.to_table(keyed.event_log(stream), str(tmp_path / "log"), str(tmp_path / "c"), mode="append").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["job_id"], r["sequence"], r["event_id"]) for r in got.collect()) == sorted((j, k + 1, e) for j, es in arrived.items() for k, e in enumerate(es))
    from granary.operators.control import events_after

    after = events_after(got.filter("job_id = 1"), 1, 10)
    assert [r["sequence"] for r in after.collect()] == list(range(11, len(arrived[1]) + 1))


def test_leases_expire(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    minute = 60_000
    batches = [
        [(1, t(0), "claim", 10 * minute), (2, t(0), "claim", 10 * minute), (3, t(1), "claim", 90 * minute)],
        [(1, t(5), "sent", 0), (2, t(6), "claim", 10 * minute), (4, t(60), "claim", 5 * minute)],  # 2 is held; an hour on its lease has ended
        [(2, t(61), "claim", 10 * minute), (3, t(62), "sent", 0), (2, t(80), "sent", 0)],  # 2 was free and is claimed; sent too late
    ]
    for rows in batches:
        spark.createDataFrame(rows, "id long, at timestamp, action string, lease_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, at timestamp, action string, lease_ms long").parquet(str(tmp_path / "in"))
        keyed.to_table(keyed.leases(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted((r["id"], r["at"].replace(tzinfo=None), r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([
        (1, t(0), "claimed"), (1, t(5), "sent"), (2, t(0), "claimed"), (2, t(6), "refused"), (2, t(10), "expired"), (2, t(61), "claimed"), (2, t(71), "expired"), (2, t(80), "refused"),
        (3, t(1), "claimed"), (3, t(62), "sent"), (4, t(60), "claimed"), (4, t(65), "expired"),
    ])


def test_sampler_as_a_stream(spark, arrivals, tmp_path):
    """Rounds over shuffled arrivals, one of them repeated, leave what one batch leaves."""
    events, arrive, folder = arrivals
    out, checkpoint, now = str(tmp_path / "out"), str(tmp_path / "c"), "2024-01-14 10:30:00"
    for k in range(0, 6, 2):
        arrive(k)
        arrive(k + 1)
        sampler.run_sampler(S.event_stream(spark, folder), out, checkpoint, 60, 60, every=None, now=now).awaitTermination()
    samples = bindings.samples_of(events)
    sampler.sampling_round(samples.filter("event_id % 3 = 0"), out, now, 60, 60)
    minutes = C.first_per_minute(samples)
    assert rows(sampler.raw_table(spark, out, now, 60).select(minutes.columns)) == rows(minutes)
    daily = C.daily_rollup(minutes)
    assert rows(sampler.daily_table(spark, out, now, 60).select(daily.columns)) == rows(daily)
    sampler.sampling_round(samples.filter("ts >= '2024-01-14 00:00:00'"), out, now, 3, 5)
    assert rows(sampler.raw_table(spark, out, now, 3).select(minutes.columns)) == rows(C.retain_raw(minutes, now, 3))
    assert {p.name for p in (tmp_path / "out/raw").glob("day=*")} == {f"day=2024-01-{d}" for d in (11, 12, 13, 14)}
    assert min(r["day"] for r in sampler.daily_table(spark, out, now, 5).collect()).isoformat() == "2024-01-09"
