"""Scanning a mounted directory tree with what the file system says of every entry.

``file_tree`` is a data source whose partitions are shards of directories. A scan goes level by level: the
directories to list are a table in the shared folder, each of its files is a shard that one task lists
and stats entry by entry, and what it finds is written before the next level begins. So a lost executor repeats
a shard, not the scan, and neither names nor directories come to the driver. A directory with more than
``split_at`` entries is not listed by the task that meets it: the task only counts it, draws borders from its names,
and the next round deals the ranges of names to tasks of their own (64 at most, as each has to read the names
again; what takes time is the metadata of its own range).

Rules that decide on paths apply between levels, so that an excluded directory is never listed.

Defined cases: the root is an entry with an empty path; a root that cannot be read gives no entries and one event
``root_unavailable``; an entry whose metadata cannot be read keeps its name and kind, its values are null and
scan_error says why; an entry that vanishes meanwhile is an event and no entry; a directory that cannot be listed keeps
its own values and gets a scan_error; what lies on another device is an entry with scan_error ``mount_boundary`` and
not descended into; symbolic links are entries and never followed; names that are not UTF-8 keep their bytes in
raw_path, and are shown with replacement characters.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import stat
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granary.functions import expressions as X
from granary.sources.stages import new_folder, stage

#: Rows a task hands over at a time.
BATCH = 4096
#: Directories in a shard.
SHARD_FOLDERS = 500
#: Entries beyond which a directory is dealt by ranges of names, and the most ranges.
SPLIT_AT, MOST_RANGES = 20_000, 64
#: Bytes read at a time when a file is hashed.
BLOCK = 1 << 20

_FIELDS = {
    "kind": "string", "raw_path": "binary", "entry_kind": "string", "device_id": "string", "inode_id": "string", "nlink": "long", "uid": "long", "gid": "long", "mode": "long",
    "size_bytes": "long", "allocated_bytes_estimate": "long", "mtime_sec": "long", "mtime_nsec": "long", "atime_sec": "long", "atime_nsec": "long", "ctime_sec": "long", "ctime_nsec": "long",
    "scan_error": "string", "errno": "int", "from_name": "binary", "to_name": "binary",
}
_ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in _FIELDS.items()])
#: What a scan reports beside entries: fixed names.
EVENTS = ("root_unavailable", "permission_denied", "read_dir", "stat", "vanished", "mount_boundary")


def _kind_of(mode: int) -> str:
    return "regular_file" if stat.S_ISREG(mode) else "directory" if stat.S_ISDIR(mode) else "symlink" if stat.S_ISLNK(mode) else "other"


def _entry(path: bytes, s: os.stat_result) -> dict:
    regular = stat.S_ISREG(s.st_mode)
    out = {
        "kind": "entry", "raw_path": path, "entry_kind": _kind_of(s.st_mode), "device_id": str(s.st_dev), "inode_id": str(s.st_ino), "nlink": s.st_nlink, "uid": s.st_uid, "gid": s.st_gid, "mode": s.st_mode,
        "size_bytes": s.st_size if regular else None, "allocated_bytes_estimate": s.st_blocks * 512 if regular else None,
    }
    for name in ("mtime", "atime", "ctime"):
        out[f"{name}_sec"], out[f"{name}_nsec"] = divmod(getattr(s, f"st_{name}_ns"), 1_000_000_000)
    return out


def _event(kind: str, path: bytes, error: OSError | None = None) -> dict:
    return {"kind": kind, "raw_path": path, "errno": error.errno if error else None, "scan_error": error.strerror if error else None}


def _code(error: OSError, otherwise: str) -> str:
    return "vanished" if isinstance(error, FileNotFoundError) else "permission_denied" if isinstance(error, PermissionError) else otherwise


def list_folder(root: bytes, path: bytes, first: bytes | None, last: bytes | None, device: int, split_at: int) -> Iterator[dict]:
    """Rows of a directory's children, or of those with ``first <= name < last``; or the ranges to deal them by."""

    def names() -> Iterator[os.DirEntry]:
        with os.scandir(os.path.join(root, path) if path else root) as found:
            for e in found:
                if (first is None or e.name >= first) and (last is None or e.name < last):
                    yield e

    whole = first is None and last is None
    try:
        if whole:
            held, drawn, n = [], [], 0
            for e in names():
                n += 1
                if n <= split_at:
                    held.append(e)
                    continue
                if held:  # too many: from here on only a bounded draw of names is kept
                    drawn = heapq.nsmallest(4096, ((hashlib.blake2b(x.name, digest_size=8).digest(), x.name) for x in held))
                    drawn, held = [(tuple(255 - b for b in h), name) for h, name in drawn], []
                    heapq.heapify(drawn)
                mark = (tuple(255 - b for b in hashlib.blake2b(e.name, digest_size=8).digest()), e.name)
                if len(drawn) < 4096:
                    heapq.heappush(drawn, mark)
                else:
                    heapq.heappushpop(drawn, mark)
            if n > split_at:
                known, parts = sorted(name for _, name in drawn), min(MOST_RANGES, -(-n // split_at) * 2)
                borders = sorted({known[k * len(known) // parts] for k in range(1, parts)})
                for a, z in zip([None, *borders], [*borders, None]):
                    yield {"kind": "range", "raw_path": path, "from_name": a, "to_name": z} if borders else {"kind": "range", "raw_path": path, "from_name": b"", "to_name": None}
                return
            children = iter(held)
        else:
            children = names()
        for e in children:
            yield from _child(path + b"/" + e.name if path else e.name, e, device)
    except OSError as error:
        yield _event(_code(error, "read_dir"), path, error) | {"entry_kind": "directory"}


def _child(path: bytes, e: os.DirEntry, device: int) -> Iterator[dict]:
    try:
        s = e.stat(follow_symlinks=False)
    except OSError as error:
        code = _code(error, "stat")
        yield _event(code, path, error)
        if code != "vanished":
            kind = "directory" if e.is_dir(follow_symlinks=False) else "symlink" if e.is_symlink() else "regular_file" if e.is_file(follow_symlinks=False) else "other"
            yield {"kind": "entry", "raw_path": path, "entry_kind": kind, "scan_error": "permission_denied" if code == "permission_denied" else "stat_failed"}
        return
    if s.st_dev != device:
        yield _event("mount_boundary", path)
        yield {"kind": "entry", "raw_path": path, "entry_kind": _kind_of(s.st_mode), "scan_error": "mount_boundary"}
    else:
        yield _entry(path, s)


@dataclass
class Shard(InputPartition):
    """A file of the table of directories; None: the root itself."""

    file: str | None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.fsencode(options["root"])
        self.folders, self.split_at = options.get("folders"), int(options.get("split_at", SPLIT_AT))

    def partitions(self) -> list[Shard]:
        if self.folders is None:
            return [Shard(None)]
        system, place = fs.FileSystem.from_uri(self.folders)
        found = system.get_file_info(fs.FileSelector(place))
        return [Shard(x.path) for x in found if x.path.endswith(".parquet")]

    def rows(self, shard: Shard) -> Iterator[dict]:
        try:
            top = os.stat(self.root)
        except OSError as error:
            yield _event("root_unavailable", b"", error)
            return
        if shard.file is None:
            yield _entry(b"", top)
            return
        system, _ = fs.FileSystem.from_uri(self.folders)
        for b in pq.ParquetFile(system.open_input_file(shard.file)).iter_batches(BATCH):
            for r in b.to_pylist():
                yield from list_folder(self.root, r["raw_path"], r["from_name"], r["to_name"], top.st_dev, self.split_at)

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        held = []
        for row in self.rows(shard):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class FileTree(DataSource):
    """``spark.read.format("file_tree")`` with the options root, folders (a table of directories; without it, the root's own row) and split_at."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in _FIELDS.items())

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


@dataclass
class Scan:
    """Entries, events (source_id, raw_path, event, errno, message) and what rules left out (source_id, raw_path, path, reason)."""

    entries: DataFrame
    events: DataFrame
    excluded: DataFrame


def scan_tree(spark: SparkSession, root: str, source_id: str, *, exclude: Callable[[Column, Column], Column] | None = None, shard_folders: int = SHARD_FOLDERS, split_at: int = SPLIT_AT) -> Scan:
    """Scans a tree that is mounted on every executor under the same path.

    ``exclude`` makes of (path, is directory) the reason to leave an entry out, or null (as ``PathRules.reason``).
    One job for each level of depth, and one more where large directories are dealt by ranges.
    """
    spark.dataSource.register(FileTree)
    source = spark.read.format("file_tree").option("root", root).option("split_at", split_at)
    path, is_dir = F.make_valid_utf8(F.col("raw_path").cast("string")), F.col("entry_kind") == "directory"
    reason = F.lit(None).cast("string") if exclude is None else exclude(F.col("path"), F.coalesce(is_dir, F.lit(False)))
    levels, level = [], source
    while True:
        found = level.load().withColumn("path", path)
        rows = stage(found.withColumn("reason", F.when(F.col("kind") == "entry", reason)), "tree-level")
        levels.append(rows)
        into = rows.filter((F.col("kind") == "range") | ((F.col("kind") == "entry") & is_dir & F.col("scan_error").isNull() & F.col("reason").isNull()))
        n = into.count()
        if not n:
            break
        folders = new_folder(spark, "tree-folders")
        files = max(-(-n // shard_folders), min(n, spark.sparkContext.defaultParallelism))
        into.select("raw_path", "from_name", "to_name").repartition(files, "raw_path", "from_name").write.parquet(folders)
        level = source.option("folders", folders)
    every = levels[0]
    for rows in levels[1:]:
        every = every.unionByName(rows)
    return Scan(_entries(every, source_id), _events(every, source_id), every.filter(F.col("reason").isNotNull()).select(F.lit(source_id).alias("source_id"), "raw_path", "path", "reason"))


def _events(rows: DataFrame, source_id: str) -> DataFrame:
    return rows.filter(F.col("kind").isin(*EVENTS)).select(F.lit(source_id).alias("source_id"), "raw_path", F.col("kind").alias("event"), "errno", F.col("scan_error").alias("message"))


def _entries(rows: DataFrame, source_id: str) -> DataFrame:
    unlisted = rows.filter(F.col("kind").isin("permission_denied", "read_dir", "vanished") & (F.col("entry_kind") == "directory")).select("raw_path", F.lit("not_listed").alias("list_error")).distinct()
    source, here = F.lit(source_id), F.col("raw_path")
    above = F.regexp_replace(F.hex(here), "(?:^|2F)(?:(?!2F)..)*$", "")  # in hex, pairs of digits: the last component goes
    name = F.make_valid_utf8(F.unhex(F.regexp_extract(F.hex(here), "((?:(?!2F)..)*)$", 1)).cast("string"))
    regular = F.col("entry_kind") == "regular_file"
    category, extension = X.classify(name)
    kept = rows.filter((F.col("kind") == "entry") & F.col("reason").isNull()).join(unlisted, "raw_path", "left")
    return kept.select(
        F.xxhash64(source, here).alias("entry_id"), F.when(F.octet_length(here) > 0, F.xxhash64(source, F.unhex(above))).alias("parent_entry_id"), source.alias("source_id"),
        "raw_path", "path", name.alias("display_name"), (F.is_valid_utf8(here.cast("string")) == F.lit(False)).alias("path_encoding_warning"), "entry_kind",
        F.when(regular, F.concat_ws(":", "device_id", "inode_id")).alias("file_identity_key_or_empty"), "device_id", "inode_id", "nlink", "uid", "gid", "mode", "size_bytes", "allocated_bytes_estimate",
        "mtime_sec", "mtime_nsec", "atime_sec", "atime_nsec", "ctime_sec", "ctime_nsec", F.when(regular, category).alias("category_id"), F.when(regular, extension).alias("extension"),
        F.coalesce("scan_error", "list_error").alias("scan_error"),
    ).withColumn("file_identity_key_or_empty", F.when(F.col("inode_id").isNotNull(), F.col("file_identity_key_or_empty"))).withColumnRenamed("file_identity_key_or_empty", "file_identity_key")


def source_status(scan: Scan) -> DataFrame:
    """One row: status (unavailable, partial, complete) and the counts of errors, vanished entries, mount boundaries and excluded entries."""
    of = lambda *kinds: F.count_if(F.col("event").isin(*kinds))
    counts = scan.events.agg(of("root_unavailable").alias("unavailable"), of("permission_denied", "read_dir", "stat", "root_unavailable").alias("error_count"), of("vanished").alias("vanished_count"), of("mount_boundary").alias("mount_boundary_count"))
    status = F.when(F.col("unavailable") > 0, "unavailable").when((F.col("error_count") > 0) | (F.col("vanished_count") > 0), "partial").otherwise("complete")
    return counts.select(status.alias("status"), "error_count", "vanished_count", "mount_boundary_count", F.lit(scan.excluded.count()).alias("excluded_count"))


class MountedContents:
    """Contents of scanned files, read in the tasks in blocks: files of any size, and never a whole one in memory.

    A file whose size or time changes while it is read is read once more, then given up: its digest is null.
    """

    def __init__(self, entries: DataFrame, root: str):
        self.paths, self.root = entries.select("entry_id", "raw_path"), os.fsencode(root)

    def samples(self, entries: DataFrame, region: int, threshold: int) -> DataFrame:
        """entry_id and sample_hash of the entries: three regions are read of each."""

        def sample(f, size: int) -> str | None:
            if size <= threshold:
                return None
            h = hashlib.sha256(struct.pack("<IQ", X.HASH_VERSION, size))
            for offset in (0, size // 2 - region // 2, size - region):
                f.seek(offset)
                h.update(struct.pack("<QQ", offset, region) + f.read(region))
            return h.hexdigest()

        return self._read(entries, sample, "sample_hash")

    def digests(self, entries: DataFrame) -> DataFrame:
        """entry_id and full_sha256 of the entries."""

        def digest(f, size: int) -> str:
            h = hashlib.sha256()
            while block := f.read(BLOCK):
                h.update(block)
            return h.hexdigest()

        return self._read(entries, digest, "full_sha256")

    def _read(self, entries: DataFrame, of: Callable, name: str) -> DataFrame:
        root = self.root

        def one(path: bytes) -> str | None:
            for _ in range(2):
                try:
                    with open(os.path.join(root, path), "rb", buffering=0) as f:
                        before = os.fstat(f.fileno())
                        found, after = of(f, before.st_size), os.fstat(f.fileno())
                except OSError:
                    return None
                if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns):
                    return found
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(p) for p in b.column(1).to_pylist()], pa.string())], ["entry_id", name])

        wanted = self.paths.join(entries.select("entry_id"), "entry_id", "left_semi")
        tasks = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return wanted.repartition(tasks, "entry_id").mapInArrow(run, f"entry_id long, {name} string")
