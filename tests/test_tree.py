"""The scan of a mounted tree against a walk of its own."""

import hashlib
import os
import stat

import pytest

from granary.operators import duplicates as D
from granary.operators.aggregates import directory_rollup
from granary.operators.digest_cache import DigestCache
from granary.operators.rules import PathRules
from granary.sources import tree as T
from pyspark.sql import functions as F


def walk(root):
    """raw path to (kind, device:inode, nlink, size, allocated, mtime)."""
    out = {}

    def one(path):
        s = os.lstat(os.path.join(root, path) if path else root)
        regular = stat.S_ISREG(s.st_mode)
        out[path] = (T._kind_of(s.st_mode), f"{s.st_dev}:{s.st_ino}" if regular else None, s.st_nlink, s.st_size if regular else None, s.st_blocks * 512 if regular else None, s.st_mtime_ns)
        if stat.S_ISDIR(s.st_mode):
            for name in os.listdir(os.path.join(root, path) if path else root):
                one(path + b"/" + name if path else name)

    one(b"")
    return out


def scanned(scan):
    return {bytes(r["raw_path"]): (r["entry_kind"], r["file_identity_key"], r["nlink"], r["size_bytes"], r["allocated_bytes_estimate"], r["mtime_sec"] * 10**9 + r["mtime_nsec"]) for r in scan.entries.collect()}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "top"
    (top / "a/b/c/d").mkdir(parents=True)
    (top / "empty").mkdir()
    (top / "a/one.tar.gz").write_bytes(b"x" * 300_000)
    (top / "a/b/two.txt").write_bytes(b"x" * 300_000)
    (top / "a/b/c/d/none").write_bytes(b"")
    os.link(top / "a/one.tar.gz", top / "a/b/c/hard")
    os.symlink("../a", top / "empty/loop")
    os.mkfifo(top / "a/pipe")
    with open(os.path.join(os.fsencode(top), b"bad\xff.txt"), "wb") as f:
        f.write(b"1")
    (top / ".git").mkdir()
    (top / ".git/deep").mkdir()
    return top


def test_same_rows_as_a_walk(spark, root):
    scan = T.scan_tree(spark, str(root), "s", shard_folders=1)
    assert scanned(scan) == walk(os.fsencode(root))
    rows = {bytes(r["raw_path"]): r for r in scan.entries.collect()}
    assert rows[b"bad\xff.txt"]["path_encoding_warning"] and rows[b"bad\xff.txt"]["display_name"] == "bad�.txt" and not rows[b"a"]["path_encoding_warning"]
    assert rows[b"a/one.tar.gz"]["file_identity_key"] == rows[b"a/b/c/hard"]["file_identity_key"] and rows[b"a/one.tar.gz"]["extension"] == "tar.gz"
    assert rows[b""]["parent_entry_id"] is None
    for path, r in rows.items():
        if path:
            assert r["parent_entry_id"] == rows[path.rpartition(b"/")[0]]["entry_id"] and r["display_name"] == path.rpartition(b"/")[2].decode("utf-8", "replace")
    assert T.source_status(scan).first()["status"] == "complete"


def test_a_hard_link_counts_once(spark, root):
    files = T.scan_tree(spark, str(root), "s").entries.filter("entry_kind = 'regular_file'")
    top = directory_rollup(files).filter("path = ''").first()
    assert (top["file_count"], top["logical_bytes"], top["unique_bytes"]) == (5, 900_001, 600_001)


def test_large_folders_are_dealt_by_names(spark, tmp_path):
    top = tmp_path / "many"
    (top / "sub").mkdir(parents=True)
    for k in range(3000):
        (top / f"{k * 7919 % 3000:05d}-{k}").touch()
    scan = T.scan_tree(spark, str(top), "s", split_at=500)
    assert scanned(scan) == walk(os.fsencode(top))
    ranges = list(T.list_folder(os.fsencode(top), b"", None, None, os.stat(top).st_dev, 500))
    assert len(ranges) == 14 and all(r["kind"] == "range" for r in ranges)
    parts = [sum(1 for _ in T.list_folder(os.fsencode(top), b"", r["from_name"], r["to_name"], os.stat(top).st_dev, 500)) for r in ranges]
    assert sum(parts) == 3001 and max(parts) < 500


def test_rules_keep_folders_from_being_listed(spark, root):
    scan = T.scan_tree(spark, str(root), "s", exclude=PathRules(exclude=("*.txt",)).reason)
    want = {p for p in walk(os.fsencode(root)) if not p.startswith(b".git") and not p.endswith(b".txt")}
    assert set(scanned(scan)) == want
    assert {bytes(r["raw_path"]): r["reason"] for r in scan.excluded.collect()} == {b".git": "hidden", b"a/b/two.txt": "exclude_glob", b"bad\xff.txt": "exclude_glob"}  # .git/deep was never met


def test_what_cannot_be_read(root, monkeypatch):
    """A folder that cannot be listed, an entry that cannot be read, one that vanishes, and one on another device."""
    real, device = os.scandir, os.stat(root).st_dev

    class Odd:
        def __init__(self, e, error=None, other=False):
            self.name, self.e, self.error, self.other = e.name, e, error, other

        def stat(self, follow_symlinks):
            if self.error:
                raise self.error
            s = self.e.stat(follow_symlinks=follow_symlinks)
            return os.stat_result((*s[:2], device + 1, *s[3:]), s.__reduce__()[1][1] | {"st_blocks": 0}) if self.other else s

        def __getattr__(self, name):
            return getattr(self.e, name)

    class Listing:
        def __init__(self, path):
            if path.endswith(b"/a/b"):
                raise PermissionError(13, "denied")
            self.found = real(path)

        def __enter__(self):
            return (Odd(e, {b"pipe": OSError(5, "broken"), b"one.tar.gz": FileNotFoundError(2, "gone")}.get(e.name), e.name == b"b") for e in self.found)

        def __exit__(self, *_):
            self.found.close()

    monkeypatch.setattr(T.os, "scandir", Listing)
    rows = list(T.list_folder(os.fsencode(root), b"a/b", None, None, device, 100))
    assert [(r["kind"], r["raw_path"], r["errno"], r["entry_kind"]) for r in rows] == [("permission_denied", b"a/b", 13, "directory")]
    rows = {(r["kind"], r["raw_path"]): r for r in T.list_folder(os.fsencode(root), b"a", None, None, device, 100)}
    assert set(rows) == {("stat", b"a/pipe"), ("entry", b"a/pipe"), ("vanished", b"a/one.tar.gz"), ("mount_boundary", b"a/b"), ("entry", b"a/b")}
    assert rows["entry", b"a/pipe"]["scan_error"] == "stat_failed" and rows["entry", b"a/pipe"]["entry_kind"] == "other" and "size_bytes" not in rows["entry", b"a/pipe"]
    assert rows["entry", b"a/b"]["scan_error"] == "mount_boundary"


def test_a_folder_that_cannot_be_listed_keeps_its_row(spark):
    at = {n: None for n in T._FIELDS}
    rows = [at | {"kind": "entry", "raw_path": b"locked", "entry_kind": "directory", "uid": 5, "inode_id": "7", "device_id": "1"}, at | {"kind": "permission_denied", "raw_path": b"locked", "entry_kind": "directory", "errno": 13}]
    df = spark.createDataFrame([tuple(r.values()) + ("locked", None) for r in rows], T.FileTree({}).schema() + ", path string, reason string")
    (r,) = T._entries(df, "s").collect()
    assert (r["uid"], r["scan_error"], r["file_identity_key"]) == (5, "not_listed", None)
    scan = T.Scan(T._entries(df, "s"), T._events(df, "s"), df.limit(0))
    assert tuple(T.source_status(scan).first()) == ("partial", 1, 0, 0, 0)


def test_a_root_that_is_not_there(spark, tmp_path):
    scan = T.scan_tree(spark, str(tmp_path / "nowhere"), "s")
    assert scan.entries.count() == 0 and T.source_status(scan).first()["status"] == "unavailable"


def test_duplicates_on_disk_through_the_cache(spark, root, tmp_path):
    cache = DigestCache(spark, str(tmp_path / "cache"))

    def run(name):
        from granary.functions.expressions import hash_cache_key

        scan = T.scan_tree(spark, str(root), "s")
        key = hash_cache_key(F.lit(1), F.col("device_id").cast("long"), F.col("inode_id").cast("long"), F.col("size_bytes"), (F.col("mtime_sec"), F.col("mtime_nsec")), (F.col("ctime_sec"), F.col("ctime_nsec")))
        files = scan.entries.filter("entry_kind = 'regular_file'").withColumn("cache_key", key)
        found = cache.hashed(D.candidates(files, keep=("cache_key",)), T.MountedContents(files, str(root)), name)
        return found.join(files.select("entry_id", "path"), "entry_id").collect(), D.groups(found).collect()

    rows, (group,) = run("r1")
    assert {r["path"]: r["was_read"] for r in rows} == {"a/one.tar.gz": True, "a/b/two.txt": True, "a/b/c/hard": True}
    assert (group["member_count"], group["identities"], group["sha256"]) == (3, 2, hashlib.sha256(b"x" * 300_000).hexdigest())
    rows, _ = run("r2")
    assert not any(r["was_read"] for r in rows)
    os.utime(root / "a/b/two.txt", ns=(1, 1))
    rows, (group,) = run("r3")
    assert {r["path"]: r["was_read"] for r in rows} == {"a/one.tar.gz": False, "a/b/two.txt": True, "a/b/c/hard": False} and group["member_count"] == 3


def test_samples_equal_those_of_a_table(spark, root):
    entries = T.scan_tree(spark, str(root), "s").entries.filter("entry_kind = 'regular_file'")
    table = D.ContentTable(spark.createDataFrame([(r["entry_id"], (root / r["path"]).read_bytes()) for r in entries.collect() if r["path"] != "bad�.txt"], "entry_id long, content binary"))
    big = entries.filter("size_bytes > 196608").select("entry_id")
    assert sorted(map(tuple, T.MountedContents(entries, str(root)).samples(big, 65536, 196608).collect())) == sorted(map(tuple, table.samples(big, 65536, 196608).collect()))
