"""Exports (CSV, JSON, HTML) and published reports; archives of them are in :mod:`granary.sources.archive`.

Rows are rendered as text by column expressions, in the tasks that hold them; one file is written for
each partition, with the frame (header, envelope) kept apart, so an export of any size never passes the
driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.expressions import csv_field, guard_formula, html_escape

#: The fields that each exported row has, in this order.
BASE_FIELDS = ("report_id", "source_name", "relative_path_display", "owner_uid", "category", "logical_size_bytes", "allocated_size_estimate_bytes", "mtime", "atime", "status")
BOM = "﻿"


def check_schema(rows: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    """The columns in order; ValueError if a field is missing or undeclared."""
    wanted = [*BASE_FIELDS, *extra]
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"missing fields: {missing}")
    if more := [c for c in rows.columns if c not in wanted]:
        raise ValueError(f"undeclared fields: {more}")
    return wanted


def csv_record(columns: list[str]) -> Column:
    return F.concat(F.concat_ws(",", *(csv_field(guard_formula(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns)), F.lit("\r"))


def csv_lines(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One text line (closed by CR; the writer adds LF) for each row."""
    return rows.select(csv_record(check_schema(rows, extra)).alias("value"))


def json_lines(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(F.to_json(F.struct(*check_schema(rows, extra)), {"ignoreNullFields": "false"}).alias("value"))


def html_rows(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in check_schema(rows, extra)]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_csv(rows: DataFrame, folder: str, extra: tuple[str, ...] = ()) -> None:
    """Part files without headers, and a header file that begins with the byte-order mark: concatenated in name order they are one CSV."""
    spark, columns = rows.sparkSession, check_schema(rows, extra)
    csv_lines(rows, extra).write.option("lineSep", "\n").text(f"{folder}/rows")
    spark.createDataFrame([(BOM + ",".join(columns) + "\r",)], "value string").coalesce(1).write.text(f"{folder}/header")


def write_json(rows: DataFrame, folder: str, manifest: dict, extra: tuple[str, ...] = ()) -> None:
    columns = check_schema(rows, extra)
    json_lines(rows, extra).write.text(f"{folder}/rows")
    rows.sparkSession.createDataFrame([(json.dumps({"manifest": manifest, "columns": columns}, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/envelope")


def write_html(rows: DataFrame, folder: str, extra: tuple[str, ...] = ()) -> None:
    columns = check_schema(rows, extra)
    html_rows(rows, extra).write.text(f"{folder}/rows")
    head = "<!doctype html><meta charset=utf-8><table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/header")


def full_report(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as one table, tagged by section; a field that a section lacks is null."""
    out = None
    for name, rows in sections.items():
        tagged = rows.withColumn("section", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and sha256 of every part file below a folder, hashed as streams in the tasks: files may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["path", "bytes", "sha256"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    return listed.repartition("path").mapInArrow(run, "path string, bytes long, sha256 string")


def publish_report(tables: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    """Writes tables, checksums and manifest beside the target, then renames the whole: a report is there or it is not.

    The rename is one step on HDFS and on mounted file systems. On an object store it is not: there, take a report as
    published when its manifest is there.

    checksums: the SHA-256 of every data file (name, bytes, sha256), taken in the tasks that read it back; the
    manifest has each table's rows and the digest of the checksums.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    staged = f"{folder}.staged-{uuid.uuid4().hex}"
    rows, sums = {}, None
    for name, t in tables.items():
        t.write.parquet(f"{staged}/{name}")
        rows[name] = {"rows": spark.read.parquet(f"{staged}/{name}").count()}
        own = file_digests(spark, f"{staged}/{name}").select(F.concat(F.lit(f"{name}/"), F.element_at(F.split("path", "/"), -1)).alias("name"), "bytes", "sha256")
        sums = own if sums is None else sums.unionByName(own)
    sums.write.parquet(f"{staged}/checksums")
    of_files = spark.read.parquet(f"{staged}/checksums").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "name"))), "\n"), 256).alias("d")).first()["d"]  # a line a file
    spark.createDataFrame([(json.dumps({**manifest, "tables": rows, "checksums_sha256": of_files}),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path(folder)) or not store.rename(path(staged), path(folder)):
        store.delete(path(staged), True)
        raise FileExistsError(folder)
