"""Rules, paging, capacity, comparison, control logic, sinks and streams."""

import hashlib
import json
import zipfile
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import expressions as X
from granary.functions.categories import DEFAULT_RULESET, Ruleset
from granary.functions import schedule
from granary.functions.schedule import occurrences, parse_cron
from granary.operators import capacity as C
from granary.operators import aggregates, compare, control
from granary.operators import file_query as Q
from granary.operators.rules import PathRules
from granary.sources import archive, bindings, files, sinks


def one(spark, expr, **values):
    kinds = {str: "string", int: "long", bytes: "binary", type(None): "string"}
    names = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], names).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("path,is_dir,want", [
    ("", True, None), ("a/cache/x", False, "system_forced"), ("a/@eaDir/x", False, "system_preset"), (".git/config", False, "hidden"), ("a/b.tmp", False, "exclude_glob"),
    ("a/deep/er/skip/x.txt", False, "exclude_glob"), ("a/x.txt", False, None), ("a/x.bin", False, "not_included"), ("a/x.bin", True, None), ("A/X.TXT", False, "not_included"),
])
def test_rules(spark, path, is_dir, want):
    rules = PathRules(exclude=("*.tmp", "**/skip/**"), include=("*.txt",))
    assert one(spark, rules.reason("p", F.lit(is_dir)), p=path) == want


def test_globs():
    import re

    def hit(g, p):
        return re.match(X.glob_regex(g), p) is not None

    assert hit("a/*.c", "a/x.c") and not hit("a/*.c", "a/b/x.c") and hit("a/**/x.c", "a/x.c") and hit("a/**/x.c", "a/b/c/x.c")
    assert hit("**", "a/b") and hit("a/**", "a/b/c") and not hit("a/**", "a") and hit("[!a]?", "bc") and hit("{x,y}.c", "y.c") and not hit("a.c", "abc")


@pytest.mark.parametrize("n", [0, 5, 6, 11])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_join_up(spark, n, descending):
    rows = [(i, None if i % 3 == 0 else i // 4) for i in range(n)]
    df = spark.createDataFrame(rows, "entry_id long, size_bytes long").cache()
    for order in (Q.Order(("size_bytes",), descending), Q.metric_order("size_bytes", descending)):
        want = [r["entry_id"] for r in df.orderBy(*order.columns()).collect()]
        got, last = [], None
        while True:
            shown, last = Q.page(df, order, 5, last)
            got += [r["entry_id"] for r in shown]
            if last is None:
                break
        assert got == want


def test_query_specs():
    a = Q.QuerySpec(source_ids=("b", "a", "a"), extensions=("JPG",), min_size_bytes="007", mtime_from="2024-01-01T01:00:00+01:00")
    b = Q.QuerySpec(source_ids=("a", "b"), extensions=("jpg",), min_size_bytes="7", mtime_from="2024-01-01T00:00:00Z")
    assert a.hash() == b.hash() and a.canonical() == b.canonical()
    for bad in (Q.QuerySpec(min_size_bytes="9", max_size_bytes="8"), Q.QuerySpec(mtime_from="2024-01-01T00:00:00Z", mtime_to="2024-01-01T00:00:00Z"), Q.QuerySpec(sort="count"), Q.QuerySpec(max_size_bytes="-1")):
        with pytest.raises(ValueError):
            bad.canonical()
    with pytest.raises(ValueError):
        Q.QuerySpec(extensions=("txt",)).check_section("owners")
    assert Q.page_size(None) == 50 and Q.page_size(999) == 200
    assert [Q.clamped("listed", n) for n in (None, 0, 7, 10**6)] == [1000, 1, 7, 100_000] and [Q.clamped("rank", n) for n in (-1, 10**6)] == [1, 10_000]
    with pytest.raises(ValueError):
        Q.page_size(0, strict=True)
    token = Q.Cursor("r", "h", {"entry_id": 3}).sign(b"k")
    assert Q.Cursor.read(token, b"k", "r", "h").last == {"entry_id": 3}
    for key, report in ((b"x", "r"), (b"k", "other")):
        with pytest.raises(ValueError):
            Q.Cursor.read(token, key, report, "h")


def test_scalar_expressions(spark):
    assert one(spark, X.format_bytes("n"), n=1536) == "1.50 KiB" and one(spark, X.format_bytes("n"), n=1023) == "1023 B" and one(spark, X.format_bytes("n"), n=1 << 40) == "1.00 TiB"
    assert one(spark, X.guard_formula("s"), s=" =1+1") == "' =1+1" and one(spark, X.guard_formula("s"), s="a=1") == "a=1"
    assert one(spark, X.csv_field("s"), s='a"b') == '"a""b"'
    assert one(spark, X.html_escape("s"), s="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, X.encoding_warning("b"), b=b"\xff") and "�" in one(spark, X.display_path("b"), b=b"a\xff")
    assert one(spark, X.path_overlaps("a", "b"), a="x/y", b="x/y/z") and not one(spark, X.path_overlaps("a", "b"), a="x/y", b="x/yz")
    assert one(spark, X.depth("s"), s="/a//b/") == 2 and one(spark, X.ancestors("s"), s="a/b/c") == ["", "a", "a/b"] and one(spark, X.ancestors("s"), s="") == []
    assert one(spark, X.usage_percent("u", "t"), u=1, t=3) == 33.33 and one(spark, X.usage_percent("u", "t"), u=1, t=0) is None
    assert str(one(spark, X.minute_ceil(F.lit("2024-01-01 00:00:01").cast("timestamp")))) == "2024-01-01 00:01:00"
    assert str(one(spark, X.minute_ceil(F.lit("2024-01-01 00:01:00").cast("timestamp")))) == "2024-01-01 00:01:00"
    hidden = json.loads(one(spark, X.without_secrets("s"), s='{"a":[{"smtp_PASSword":1,"b":2}],"Token":"x"}'))
    assert hidden == {"a": [{"smtp_PASSword": "<redacted>", "b": 2}], "Token": "<redacted>"}
    assert one(spark, X.valid_extension("s"), s="tar.gz") and not one(spark, X.valid_extension("s"), s="a..b")
    assert one(spark, X.numeric_order("s"), s="18446744073709551615") == 2**64 - 1


def test_rulesets():
    r = DEFAULT_RULESET.derive({"log": "documents"}, ["ts"])
    assert r.version == 2 and r.mapping["log"] == "documents" and "ts" not in r.mapping
    for bad in (lambda: DEFAULT_RULESET.derive({"ts": "videos"}, ["ts"]), lambda: Ruleset(1, {"A": "audio"}), lambda: Ruleset(1, {"a": "none"})):
        with pytest.raises(ValueError):
            bad()


def _samples(spark, rows):
    kind = "event_id long, volume_id string, sample_time string, used_bytes string, quality string"
    df = spark.createDataFrame(rows, kind)
    u = F.col("used_bytes").cast("decimal(20,0)")
    return df.select("event_id", "volume_id", F.col("sample_time").cast("timestamp").alias("sample_time"), u.alias("total_bytes"), u.alias("free_bytes"), u.alias("available_bytes"), u.alias("used_bytes"), "quality")


def test_capacity_days(spark):
    big = str(2**64 - 1)
    s = _samples(spark, [(1, "v", "2024-01-01 00:00:00", "9", "ok"), (2, "v", "2024-01-01 05:00:00", big, "ok"), (3, "v", "2024-01-01 06:00:00", "10", "ok"), (4, "v", "2024-01-01 07:00:00", None, "error"), (5, "v", "2024-01-03 00:00:00", "1", "ok")])
    days = {str(r["day"]): r for r in C.daily_rollup(s).collect()}
    assert set(days) == {"2024-01-01", "2024-01-03"}  # a day without samples stays a gap
    d = days["2024-01-01"]
    assert (int(d["used_min"]), int(d["used_max"]), int(d["used_last"]), d["sample_count"]) == (9, 2**64 - 1, 10, 3)
    raw, daily = C.maintain(s, C.daily_rollup(s).limit(0), "2024-01-03 12:00:00", 1, 30)
    assert raw.count() == 1 and daily.count() == 2
    assert C.merge_daily(daily, C.daily_rollup(raw)).count() == 2  # compacted days outlive their raw rows
    assert C.daily_history(daily, "2024-01-01 00:00:00", "2024-01-03 01:00:00").count() == 2
    assert C.daily_history(daily, "2024-01-01 00:00:00", "2024-01-03 00:00:00").count() == 1
    assert C.capacity_total(C.latest_per_volume(s), s.filter("false")).first()["total_bytes"] is None


def test_pages_of_several_volumes_join_up(spark):
    minutes = [f"2024-01-01 00:{m:02d}:00" for m in range(5)]
    s = _samples(spark, [(k, v, t, "1", "ok") for k, (v, t) in enumerate((v, t) for v in "ab" for t in minutes)])
    got, after = [], None
    while rows := C.raw_history(s, "2024-01-01 00:00:00", "2024-01-02 00:00:00", after=after).limit(3).collect():
        got += rows
        after = (rows[-1]["volume_id"], rows[-1]["sample_time"])
    assert [(r["volume_id"], str(r["sample_time"])) for r in got] == [(v, t) for v in "ab" for t in minutes]


def test_stream_equals_batch(spark, small, tmp_path):
    from granary.streaming import capacity as S
    from granary.streaming.keyed import to_table

    stream = S.daily_rollup(S.event_stream(spark, small, "events.parquet"))
    S.sink_batches(stream, str(tmp_path / "daily"), str(tmp_path / "c"), every="1 second").processAllAvailable()
    spark.streams.active[0].stop()
    got = spark.read.parquet(str(tmp_path / "daily"))
    want = C.daily_rollup(bindings.raw_samples(spark, small))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    to_table(S.minute_samples(S.event_stream(spark, small, "events.parquet")), str(tmp_path / "minutes"), str(tmp_path / "d"), mode="append").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "minutes")).count() == bindings.volume_samples(spark, small).count()


def test_differences(spark):
    left = spark.createDataFrame([("s", None, 1), ("s", 2, 5), ("s", 3, None)], "source_id string, uid long, n long")
    right = spark.createDataFrame([("s", None, 4), ("s", 3, None), ("s", 9, 1)], "source_id string, uid long, n long")
    got = {r["uid"]: (r["change"], r["delta_n"]) for r in compare.snapshot_diff(left, right, ["source_id", "uid"], ["n"], deltas=["n"]).collect()}
    assert got == {None: ("changed", 3), 2: ("removed", None), 9: ("added", None)}
    a = {"status": "succeeded", "profile_id": 1, "scope_fingerprint": 1, "classification_version": 1, "source_identities": 1}
    assert compare.not_comparable(a, a) == [] and compare.not_comparable(a, {**a, "profile_id": 2, "status": "partial"}) == ["different_profile", "partial_report"]
    with pytest.raises(ValueError):
        compare.not_comparable(a, {**a, "status": "failed"})


def test_outbox_and_jobs(spark):
    box = spark.createDataFrame([(1, "pending", 0), (2, "pending", 2), (3, "pending", 3)], "id long, state string, attempts int").withColumn("next_attempt_at", F.lit("2024-01-01").cast("timestamp")).withColumn("lease_until", F.lit(None).cast("timestamp"))
    got = {r["id"]: (r["state"], str(r["next_attempt_at"])) for r in control.outbox_failed(box, "2024-01-01 00:00:00").collect()}
    assert got[1] == ("pending", "2024-01-01 00:01:00") and got[2] == ("pending", "2024-01-01 00:30:00") and got[3][0] == "failed"
    src = spark.createDataFrame([("a", "2023-01-01"), ("b", "2025-01-01")], "source_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    profile = {"sources": "all", "created_at": "2024-01-01 00:00:00"}
    assert control.profile_sources(profile, src).count() == 1 and control.profile_sources({**profile, "include_future": True}, src).count() == 2 and control.profile_sources({"sources": ["b"]}, src).count() == 1


def test_schedules():
    berlin = "Europe/Berlin"
    gap = occurrences("30 2 * * *", berlin, datetime(2024, 3, 30, 12, tzinfo=UTC), datetime(2024, 4, 1, 12, tzinfo=UTC))
    assert [(k, s) for _, k, s in gap] == [("2024-03-31T02:30", True), ("2024-04-01T02:30", False)]
    fold = occurrences("30 2 * * *", berlin, datetime(2024, 10, 26, 12, tzinfo=UTC), datetime(2024, 10, 27, 12, tzinfo=UTC))
    assert [(str(t), k) for t, k, _ in fold] == [("2024-10-27 00:30:00+00:00", "2024-10-27T02:30")]
    assert parse_cron("0 0 * * 7")[4] == {0} and parse_cron("*/15 1-3 * jan,feb mon")[0] == {0, 15, 30, 45}
    assert [k for _, k, _ in occurrences("0 0 29 2 *", "UTC", datetime(2024, 1, 1, tzinfo=UTC), datetime(2028, 12, 31, tzinfo=UTC))] == ["2024-02-29T00:00", "2028-02-29T00:00"]
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            parse_cron(bad)


def test_a_schedule_of_many_profiles_is_expanded_once(spark, monkeypatch):
    start, end = datetime(2024, 3, 30, tzinfo=UTC), datetime(2024, 4, 1, 12, tzinfo=UTC)
    zones, crons = ("Europe/Berlin", "UTC"), ("30 2 * * *", "0 */6 * * *", "0 0 1 1 *")  # the last has no occurrence
    rows = [(f"p{k}", crons[k % 3], zones[k % 2]) for k in range(500)]
    want = sorted(((p, key, at, gap) for p, cron, zone in rows for at, key, gap in occurrences(cron, zone, start, end)), key=str)
    asked = []
    monkeypatch.setattr(schedule, "occurrences", lambda *x: asked.append(x) or occurrences(*x))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 200])], ["profile_id", "cron", "zone"]) for a in range(0, 500, 200)]

    def got():
        return [tuple(r.values()) for b in schedule._expanded(iter(batches), start, end) for r in b.to_pylist()]

    assert sorted(got(), key=str) == want and len(asked) == 6
    monkeypatch.setattr(schedule, "TOGETHER", 20)
    assert sorted(got(), key=str) == want and max(b.num_rows for b in schedule._expanded(iter(batches), start, end)) < 40
    monkeypatch.setattr(schedule, "REMEMBERED", 5)
    assert sorted(got(), key=str) == want
    monkeypatch.undo()
    table = schedule.occurrence_table(spark.createDataFrame(rows, "profile_id string, cron string, zone string").repartition(3), start, end)
    assert sorted(((r[0], r[1]) for r in table.select("profile_id", "occurrence_key").collect()), key=str) == sorted((x[:2] for x in want), key=str)


def test_sinks(spark, tmp_path):
    from granary.plans.exports import files_section

    rows = files_section(bindings.file_entries(spark, "/root/testdata/sf0.001")).limit(20)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    header = next((tmp_path / "csv/header").glob("part-*")).read_bytes()
    assert header.startswith(b"\xef\xbb\xbfreport_id,") and header.endswith(b"\r\n")
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv/rows").glob("part-*")))
    assert body.count(b"\r\n") == 20
    sinks.write_json(rows, str(tmp_path / "json"), {"id": 1})
    sinks.write_html(rows, str(tmp_path / "html"))
    archive.write_archive({"files": rows}, str(tmp_path / "r.zip"), {"id": 1})
    with zipfile.ZipFile(tmp_path / "r.zip") as z:
        assert len(json.loads(z.read("files.json"))["rows"]) == 20 and set(json.loads(z.read("manifest.json"))["members"]) == {"files.csv", "files.json", "files.html"}
    with pytest.raises(ValueError):
        sinks.check_schema(rows.drop("mtime"))
    with pytest.raises(ValueError):
        sinks.check_schema(rows.withColumn("more", F.lit(1)))
    sinks.publish_report({"files": rows}, str(tmp_path / "report"), {"id": 1})
    assert files.read_report(spark, str(tmp_path / "report"), "files").count() == 20
    with pytest.raises(FileExistsError):
        sinks.publish_report({"files": rows}, str(tmp_path / "report"), {"id": 1})
    assert not list(tmp_path.glob("report.staged-*"))


def test_scan_of_real_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/b/x.tar.gz").write_bytes(b"123")
    (tmp_path / "y.txt").write_bytes(b"1")
    (tmp_path / "a/none.dat").write_bytes(b"")
    found = files.scan_files(spark, str(tmp_path), "s", content=True).collect()
    got = {r["path"]: (r["size_bytes"], r["category_id"], r["content"] and bytes(r["content"])) for r in found if r["entry_kind"] == "regular_file"}
    assert got == {"a/b/x.tar.gz": (3, "archives", b"123"), "y.txt": (1, "documents", b"1"), "a/none.dat": (0, "other", b"")}
    assert {r["path"] for r in found if r["entry_kind"] == "directory"} == {"a", "a/b", "empty"}
    assert files.scan_files(spark, str(tmp_path / "empty"), "s").count() == 0


def test_published_files_have_checksums(spark, tmp_path):
    sinks.publish_report({"t": spark.range(10), "u": spark.range(3)}, str(tmp_path / "r"), {"id": 2})
    sums = {r["name"]: r for r in files.read_report(spark, str(tmp_path / "r"), "checksums").collect()}
    parts = [p for t in "tu" for p in (tmp_path / "r" / t).glob("part-*")]
    assert len(sums) == len(parts) > 1
    for p in parts:
        r = sums[f"{p.parent.name}/{p.name}"]
        assert (r["bytes"], r["sha256"]) == (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest())
    manifest = json.loads(next((tmp_path / "r/manifest").glob("part-*")).read_text())
    assert manifest["tables"] == {"t": {"rows": 10}, "u": {"rows": 3}}
    lines = sorted(f"{r['sha256']} {n}" for n, r in sums.items())
    assert manifest["checksums_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_import_end_to_end(spark, tmp_path):
    base = {"principal_namespace": "posix", "principal_uid": 1, "scope_kind": "volume", "scope_id": "v", "metric": "space", "origin": "manual", "limit_state": "known", "observed_at": "2024-01-01T00:00:00Z", "expires_at": None, "provider_label": "p"}
    (tmp_path / "q.json").write_text(json.dumps([{**base, "id": "a", "limit_bytes": str(2**64 - 1), "used_bytes": "1"}, {**base, "id": "b", "limit_bytes": "7", "used_bytes": None}]))
    imported = files.read_import(spark, str(tmp_path / "q.json"))
    existing = files.apply_import(imported.limit(0).withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("limit_bytes", "used_bytes")}), imported.filter("id = 'a'").withColumn("limit_bytes", F.lit("5")))
    after = {r["id"]: (int(r["limit_bytes"]), r["used_bytes"]) for r in files.apply_import(existing, imported).collect()}
    assert after == {"a": (2**64 - 1, 1), "b": (7, None)}
    (tmp_path / "bad.json").write_text(json.dumps([{**base, "id": "a", "surprise": 1}]))
    with pytest.raises(ValueError):
        files.read_import(spark, str(tmp_path / "bad.json"))


def test_sums_before_in_ranges(spark):
    from granary.operators.ranges import sum_before

    rows = [(k % 3 or None, (k * 37) % 500, k % 7) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    for ranges in (1, 2, 9, 64):
        got = sum_before(df, ["g"], F.col("k"), F.col("v"), "s", ranges).collect()
        assert len(got) == 500 and all(r["s"] == sum(v for g, k, v in rows if g == r["g"] and k < r["k"]) for r in got)


def test_sums_beyond_a_long_raise(spark):
    from pyspark.errors import ArithmeticException

    df = spark.createDataFrame([(2**63 - 1,), (1,)], "size_bytes long").withColumns({"source_id": F.lit("s"), "uid": F.lit(1)})
    with pytest.raises(ArithmeticException):
        aggregates.owner_aggregate(df).collect()


def test_batches_overwrite_their_days(spark, small, tmp_path):
    from granary.streaming import capacity as S

    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in/a.parquet"))
    for run in ("c", "d"):  # a second run over the same files leaves the same rows
        q = S.sink_batches(S.daily_rollup(S.event_stream(spark, str(tmp_path / "in/a.parquet"))), str(tmp_path / "out"), str(tmp_path / run), every="1 second")
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(str(tmp_path / "out")).count() == C.daily_rollup(bindings.raw_samples(spark, small)).count()


def test_contents_are_read_last(spark, small):
    """Contents are asked for entries that sizes and identities have left, and for no others."""
    from granary.operators import duplicates as D

    asked = []

    class Noting(D.ContentTable):
        def digests(self, entries):
            asked.extend(r["entry_id"] for r in entries.collect())
            return super().digests(entries)

    files = bindings.file_entries(spark, small)
    found = D.candidates(files)
    assert set(found.columns) == {"entry_id", "size_bytes", "file_identity_key", "candidate_key"}
    D.hashed(found, Noting(bindings.file_contents(spark, small)))
    assert 0 < len(asked) < files.count() and sorted(asked) == sorted(r["entry_id"] for r in found.collect())
