"""What the operators of this subpackage share: durable tables, arrow maps, word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at just these.
SPACES = b" \t\n\x0b\x0c\r"

#: Whether Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new folder, but only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`durable` wrote."""
    p = _hadoop_path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            forget(spark, path)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder when the driver ends."""
    _written.append((spark, path))


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and a lost executor costs nothing.

    The shuffle files of the write go as soon as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind what :func:`durable` returned, when nothing will read it again."""
    _written[:] = [x for x in _written if x[1] != df.durable_path]
    forget(df.sparkSession, df.durable_path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a durable table; the tables made on the way are deleted."""
    before = len(_written)
    out = durable(make(), name)
    for spark, path in _written[before:-1]:
        forget(spark, path)
    del _written[before:-1]
    return out


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` builds once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads: other columns, whatever their names, stay out of its way."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
