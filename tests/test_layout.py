"""Archives deflated by tasks, and pages that open the files they lie in."""

import csv
import hashlib
import io
import json
import random
import zipfile
import zlib

import pytest

from granary.operators import file_query as Q
from granary.operators.pages import StoredOrder
from granary.sources import archive, sinks


def test_joined_checksums():
    rng = random.Random(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 70_001)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert archive.joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)
    parts = [rng.randbytes(k) for k in (3, 0, 500)]
    assert zlib.decompress(b"".join(map(archive.deflated, parts)) + archive._END, -15) == b"".join(parts)


def section(spark, n, parts):
    rows = [("r", "src", f'a/"{k}", <b>=1+{k}', "7", "other", str(k), None, None, None, "ok") for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in sinks.BASE_FIELDS)).repartitionByRange(parts, "logical_size_bytes").sortWithinPartitions("logical_size_bytes")


@pytest.mark.parametrize("mounted", [True, False])
def test_archive(spark, tmp_path, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(archive.fs, "LocalFileSystem", int)
    sections = {"files": section(spark, 997, 7), "empty": section(spark, 0, 2), "one": section(spark, 1, 1)}
    archive.write_archive(sections, str(tmp_path / "x.zip"), {"id": "é"})
    assert [p.name for p in tmp_path.iterdir()] == ["x.zip"]
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 10
        for name, n in (("files", 997), ("empty", 0), ("one", 1)):
            order = sorted(map(str, range(n)))
            text = z.read(f"{name}.csv").decode("utf-8-sig")
            records = list(csv.reader(io.StringIO(text, newline="")))
            assert records[0] == list(sinks.BASE_FIELDS) and [r[5] for r in records[1:]] == order
            if n:
                assert records[1][2] == 'a/"0", <b>=1+0'
            envelope = json.loads(z.read(f"{name}.json"))
            assert envelope["manifest"] == {"id": "é"} and envelope["columns"] == list(sinks.BASE_FIELDS) and [r["logical_size_bytes"] for r in envelope["rows"]] == order
            page = z.read(f"{name}.html").decode()
            assert page.count("<tr>") == n + 1 and "<b>" not in page and page.endswith("</table>\n")
        members = json.loads(z.read("manifest.json"))["members"]
        assert {n: m["rows"] for n, m in members.items()} == {f"{s}.{k}": n for s, n in (("files", 997), ("empty", 0), ("one", 1)) for k in archive.FORMATS}
        assert all(int(m["crc32"], 16) == z.getinfo(n).CRC and m["bytes"] == z.getinfo(n).file_size for n, m in members.items())
        assert members["one.csv"]["pieces_sha256"] == hashlib.sha256(hashlib.sha256(z.read("one.csv").split(b"\r\n", 1)[1]).hexdigest().encode()).hexdigest()


@pytest.mark.parametrize("sort,descending", [("size", True), ("size", False), ("atime", True), ("category", False)])
def test_a_page_opens_two_files_at_most(spark, tmp_path, sort, descending):
    rng = random.Random(4)
    pick = lambda *x: rng.choice([None, *x])
    rows = [(k, pick(*range(30)), pick(1, 2, 3), pick(0, 5), pick("a", "b")) for k in range(700)]
    df = spark.createDataFrame(rows, "entry_id long, size_bytes long, atime_sec long, atime_nsec long, category_id string")
    order = Q.order_of(Q.QuerySpec(sort=sort, descending=descending))
    stored = StoredOrder.publish(df, order, str(tmp_path / "files"), file_rows=120)
    want = [r["entry_id"] for r in df.orderBy(*order.columns()).collect()]
    got, last, more = [], None, True
    while more:
        shown, last = stored.page(90, last)
        got += [r["entry_id"] for r in shown]
        more = last is not None
    assert got == want
    assert stored.ends.count() >= 6 and max(map(len, stored.opened)) <= 2


def test_pages_of_nothing(spark, tmp_path):
    order = Q.order_of(Q.QuerySpec(sort="size"))
    empty = spark.createDataFrame([], "entry_id long, size_bytes long")
    assert StoredOrder.publish(empty, order, str(tmp_path / "none")).page(50) == ([], None)
