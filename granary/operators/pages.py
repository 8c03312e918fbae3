"""Pages by layout: a section stored in the order it is read, so that a page opens the file it lies in and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.file_query import Order, page
from granary.sources.stages import stage


class StoredOrder:
    """A table in ranges of an order, and a small one that tells what each file ends with."""

    def __init__(self, spark: SparkSession, rows: DataFrame, ends: DataFrame, order: Order):
        self.spark, self.schema, self.ends, self.order = spark, rows.schema, ends, order
        self.opened: list[list[str]] = []

    @classmethod
    def publish(cls, rows: DataFrame, order: Order, folder: str, file_rows: int = 1_000_000) -> StoredOrder:
        """Writes rows in ranges of the order; files of ``file_rows`` rows at most, in the order of their names."""
        spark, columns = rows.sparkSession, order.columns()
        rows.repartitionByRange(*columns).sortWithinPartitions(*columns).write.option("maxRecordsPerFile", file_rows).parquet(folder)
        stored = spark.read.schema(rows.schema).parquet(folder)
        keys = [*order.keys, *order.tie]
        placed = stored.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"), F.struct(*keys).alias("k"))
        ends = placed.groupBy("file").agg(F.max_by("k", "i").alias("k"), F.count(F.lit(1)).alias("n")).select("file", "n", "k.*")  # one row a file
        return cls(spark, stored, stage(ends, "file-ends"), order)

    def page(self, size: int, last: dict | None = None) -> tuple[list, dict | None]:
        """As :func:`granary.operators.file_query.page`, from the files that hold the page: those that end after the cursor, as many as it takes."""
        left = self.ends if last is None else self.ends.filter(self.order.after(last))
        files, whole = [], 0
        for f in left.orderBy("file").select("file", "n").toLocalIterator():
            whole += f["n"] if files or last is None else 0  # of the first file the cursor may leave but one row
            files.append(f["file"])
            if whole > size:
                break
        self.opened.append(files)
        if not files:
            return [], None
        return page(self.spark.read.schema(self.schema).parquet(*files), self.order, size, last)
