"""Reading real files and published reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import expressions as X
from granary.sources.stages import stage


_LISTED = "path string, is_file boolean, length long, mtime_ns long"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file and directory below a folder, files of no bytes included.

    For object stores and other file systems that :mod:`pyarrow.fs` reads; of a mounted tree :mod:`granary.sources.tree` tells
    more. Directories are listed in tasks, one level after another (a Spark job a level of depth), one folder
    at a time in memory; each level is written, and nothing but "is there a further level" comes to the driver.
    """

    def children(frames):
        import pandas as pd
        from pyarrow import fs

        for frame in frames:
            for folder in frame["path"]:
                system, path = fs.FileSystem.from_uri(folder)
                head = folder[: len(folder.rstrip("/")) - len(path.rstrip("/"))]
                rows = [(head + x.path, x.type == fs.FileType.File, x.size, x.mtime_ns) for x in system.get_file_info(fs.FileSelector(path)) if x.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pd.DataFrame(rows, columns=["path", "is_file", "length", "mtime_ns"]).astype({"path": object, "is_file": bool, "length": "Int64", "mtime_ns": "Int64"})

    root = root.rstrip("/")
    level = spark.createDataFrame([(root if "://" in root else f"file://{root}",)], "path string")
    found = None
    while True:
        level = stage(level.select("path").repartition(F.col("path")).mapInPandas(children, _LISTED), "listed")
        found = level if found is None else found.unionByName(level)
        folders = level.filter(~F.col("is_file"))
        if folders.isEmpty():
            return found
        level = folders


def scan_files(spark: SparkSession, root: str, source_id: str, *, content: bool = False) -> DataFrame:
    """File and directory entries below a folder; contents only where asked for, of files (empty ones too)."""
    rows = list_tree(spark, root)
    top = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^[a-z0-9]+:/*", "/")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    name = F.element_at(F.split("path", "/"), -1)
    category, extension = X.classify(name)
    is_file = F.col("is_file")
    if content:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/").alias("full"), "content")
        rows = rows.withColumn("full", full).join(read, "full", "left").withColumn("content", F.when(is_file, F.coalesce("content", F.lit(b""))))
    seconds = F.floor(F.col("mtime_ns") / 1_000_000_000)
    return rows.select(
        F.xxhash64(F.lit(source_id), "path").alias("entry_id"), F.lit(source_id).alias("source_id"),
        F.substr(full, F.length(top) + 1).alias("path"), name.alias("display_name"), F.when(is_file, "regular_file").otherwise("directory").alias("entry_kind"),
        F.when(is_file, F.concat_ws(":", F.lit(source_id), "path")).alias("file_identity_key"), F.when(is_file, F.col("length")).alias("size_bytes"), F.lit(None).cast("long").alias("allocated_bytes_estimate"),
        seconds.alias("mtime_sec"), (F.col("mtime_ns") % 1_000_000_000).alias("mtime_nsec"),
        F.when(is_file, category).alias("category_id"), F.when(is_file, extension).alias("extension"), *([F.col("content")] if content else []),
    )


def read_report(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a published report."""
    return spark.read.parquet(f"{folder}/{table}")


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """Quota records of a metadata import, with a fixed schema: fields it does not know are refused."""
    kind = (
        "id string, principal_namespace string, principal_uid long, scope_kind string, scope_id string, metric string, origin string, limit_state string, "
        "limit_bytes string, used_bytes string, observed_at timestamp, expires_at timestamp, provider_label string"
    )
    seen = spark.read.option("multiLine", "true").json(path)
    known = [x.split()[0] for x in kind.split(", ")]
    if extra := set(seen.columns) - set(known):
        raise ValueError(f"unknown fields: {sorted(extra)}")
    return spark.read.option("multiLine", "true").schema(kind).json(path)


def apply_import(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Quota records after an import: those with a known id are replaced, others added. Byte counts are read as numbers."""
    from granary.operators.control import upsert

    numbers = {c: F.col(c).cast("decimal(20,0)") for c in ("limit_bytes", "used_bytes")}
    return upsert(existing, imported.withColumns(numbers), ["id"])
