"""Ordered ranges: what a window over all rows would do, in pieces of bounded share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_number(rows: DataFrame, key: Column, ranges: int) -> Column:
    """The number of the range a row's key lies in, ascending. Borders are the keys with the least hashes: as many as asked for, whatever the input."""
    drawn = rows.select(key.alias("k")).filter(F.col("k").isNotNull()).distinct().orderBy(F.xxhash64("k"), "k").limit(ranges - 1)
    borders = sorted(r["k"] for r in drawn.collect())  # fewer than ``ranges`` rows
    out = F.lit(0)
    for b in borders:
        out = out + (key >= F.lit(b)).cast("int")
    return out


def sum_before(rows: DataFrame, group: list[str], key: Column, value: Column, name: str, ranges: int = 64) -> DataFrame:
    """rows with a column: the sum of ``value`` over the rows of the same group whose key (unique in it) is smaller.

    Rows are ordered within a range only; sums of whole ranges carry the rest, at most ``ranges`` rows a group.
    """
    marked = rows.withColumns({"__range": range_number(rows, key, ranges), "__key": key, "__value": value})
    w = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*group, "__range").agg(F.sum("__value").alias("__sum")).withColumn("__carried", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    own = Window.partitionBy(*group, "__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__range"]]
    joined = marked.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).alias("l").join(carried.alias("r"), same)
    return joined.select("l.*", (F.col("__own") + F.col("r.__carried")).alias(name)).drop("__range", "__key", "__value", "__own")
