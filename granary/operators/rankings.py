"""The three deterministic rankings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.file_query import clamped


def order_of(kind: str) -> list[Column]:
    """Fixed orders; nulls are smallest, ties go to the lower entry_id."""
    return {
        "largest": [F.col("size_bytes").desc_nulls_last()],
        "recently_modified": [F.col("mtime_sec").desc_nulls_last(), F.col("mtime_nsec").desc_nulls_last()],
        "least_accessed": [F.col("atime_sec").asc_nulls_first(), F.col("atime_nsec").asc_nulls_first()],
    }[kind] + [F.col("entry_id").asc()]


def ranking(files: DataFrame, kind: str, limit: int = 200, *, exclude_unknown_atime: bool = False) -> DataFrame:
    """The first rows of a kind with their rank: a distributed top-k, ranked only after it is small."""
    limit = clamped("rank", limit)
    rows = files.filter((F.col("entry_kind") == "regular_file") & F.col("size_bytes").isNotNull())
    if exclude_unknown_atime:
        rows = rows.filter(F.col("atime_sec").isNotNull())
    top = rows.orderBy(*order_of(kind)).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order_of(kind)))).withColumn("kind", F.lit(kind))
