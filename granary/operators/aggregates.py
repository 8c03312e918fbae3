"""Owner, category and extension aggregates, first occurrences and directory rollups over file entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.expressions import ancestors, parent, rollup_sum, strict_sum
from granary.operators.ranges import sum_before
from granary.sources.stages import stage


def with_first_occurrence(files: DataFrame) -> DataFrame:
    """Adds is_first: the lowest entry_id of its identity, over all sources; false without an identity.

    A partial aggregation and a join on entry_id: an identity shared by very many rows never meets in one task.
    """
    first = files.filter(F.col("file_identity_key").isNotNull()).groupBy("file_identity_key").agg(F.min("entry_id").alias("entry_id")).select("entry_id", F.lit(True).alias("is_first"))
    return files.join(first, "entry_id", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))


def owner_aggregate(files: DataFrame) -> DataFrame:
    return files.groupBy("source_id", "uid").agg(F.count(F.lit(1)).alias("file_count"), strict_sum("size_bytes").alias("logical_bytes"))


def category_aggregate(files: DataFrame) -> DataFrame:
    """Allocated bytes count each identity once; null if an identity or a first occurrence's value is unknown."""
    marked = with_first_occurrence(files.filter(F.col("category_id").isNotNull()))
    unknown = F.col("file_identity_key").isNull() | (F.col("is_first") & F.col("allocated_bytes_estimate").isNull())
    return marked.groupBy("source_id", "category_id").agg(
        F.count(F.lit(1)).alias("file_count"), strict_sum("size_bytes").alias("logical_bytes"),
        rollup_sum(F.when(F.col("is_first"), F.col("allocated_bytes_estimate")), unknown).alias("allocated_bytes"),
    )


def grouped_sizes(files: DataFrame, *keys: str) -> DataFrame:
    """File counts and strict sums by any keys; nulls are groups of their own."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("file_count"), strict_sum("size_bytes").alias("logical_bytes"), strict_sum("allocated_bytes_estimate").alias("allocated_bytes"))


def report_totals(categories: DataFrame) -> DataFrame:
    return categories.agg(F.sum("file_count").alias("files"), strict_sum("logical_bytes").alias("logical_bytes"), strict_sum("allocated_bytes").alias("allocated_bytes"))


def breakdown(aggregate: DataFrame, key: str, by: str) -> DataFrame:
    """For each key a map from ``by`` to (file_count, logical_bytes), from one aggregation."""
    inner = aggregate.groupBy(key, by).agg(F.sum("file_count").alias("file_count"), strict_sum("logical_bytes").alias("logical_bytes"))
    entry = F.struct(F.col(by).alias("key"), F.struct("file_count", "logical_bytes").alias("value"))
    return inner.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"by_{by}"))


def owner_page(aggregate: DataFrame) -> DataFrame:
    """Owners over all sources, from the aggregate by source."""
    return aggregate.groupBy("uid").agg(F.sum("file_count").alias("file_count"), strict_sum("logical_bytes").alias("logical_bytes"), F.count(F.lit(1)).alias("sources"))


def directories(files: DataFrame) -> DataFrame:
    """source_id and path of every directory that holds a file at any depth, the root (empty path) included."""
    leaves = files.select("source_id", parent("path").alias("dir")).distinct()
    return leaves.select("source_id", F.explode(F.array_append(ancestors("dir"), F.col("dir"))).alias("path")).distinct()


def directory_rollup(files: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """For each directory: files, directories, bytes and excluded entries at any depth below it.

    Files are summed by the directory they lie in first, and only these sums are multiplied by depth.
    A metric is null if a value that it needs is unknown anywhere below.
    """
    size, key, allocated, place = F.col("size_bytes"), F.col("file_identity_key"), F.col("allocated_bytes_estimate"), parent("path").alias("dir")
    rows = files.select("source_id", place, "entry_id", key, size, allocated)
    own = rows.groupBy("source_id", "dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("logical"), F.lit(None).cast("long").alias("uniq"), F.lit(None).cast("long").alias("alloc"),
        F.max(size.isNull().cast("int")).alias("bad_logical"), F.max((key.isNull() | size.isNull()).cast("int")).alias("bad_unique"), F.max((key.isNull() | allocated.isNull()).cast("int")).alias("bad_allocated"),
    )
    # an identity counts in the directory of its lowest entry, over all sources
    first = rows.filter(key.isNotNull()).groupBy("file_identity_key").agg(F.min_by(F.struct("source_id", "dir", size, allocated), "entry_id").alias("f")).select("f.*")
    none = [F.lit(0).alias(c) for c in ("bad_logical", "bad_unique", "bad_allocated")]
    firsts = first.groupBy("source_id", "dir").agg(F.lit(0).cast("long").alias("files"), F.lit(None).cast("long").alias("logical"), F.sum(size).alias("uniq"), F.sum(allocated).alias("alloc"), *none)
    leaf = stage(own.unionByName(firsts), "leaf-sums")  # two rows a directory at most
    above = leaf.withColumn("path", F.explode(F.array_append(ancestors("dir"), F.col("dir"))))
    sums = above.groupBy("source_id", "path").agg(
        F.sum("files").alias("file_count"),
        rollup_sum("logical", F.col("bad_logical") == 1).alias("logical_bytes"), rollup_sum("uniq", F.col("bad_unique") == 1).alias("unique_bytes"), rollup_sum("alloc", F.col("bad_allocated") == 1).alias("allocated_bytes"),
    )
    dirs = leaf.select("source_id", F.explode(F.array_append(ancestors("dir"), F.col("dir"))).alias("path")).distinct()
    inner = dirs.filter(F.col("path") != "").select("source_id", F.explode(ancestors("path")).alias("path")).groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("dir_count"))
    out = sums.join(inner, ["source_id", "path"], "left").withColumn("dir_count", F.coalesce("dir_count", F.lit(0).cast("long")))
    if excluded is not None:
        away = excluded.groupBy("source_id", parent("path").alias("dir")).agg(F.count(F.lit(1)).alias("n")).withColumn("path", F.explode(F.array_append(ancestors("dir"), F.col("dir"))))
        out = out.join(away.groupBy("source_id", "path").agg(F.sum("n").alias("excluded_count")), ["source_id", "path"], "left").withColumn("excluded_count", F.coalesce("excluded_count", F.lit(0).cast("long")))
    return out


def folder_snapshot(rollup: DataFrame, observations: DataFrame) -> DataFrame:
    """Rollup rows with completeness: unknown if a metric is null, else the source's status."""
    some_null = F.col("logical_bytes").isNull() | F.col("unique_bytes").isNull() | F.col("allocated_bytes").isNull()
    return rollup.join(observations.select("source_id", "status"), "source_id").withColumn("completeness", F.when(some_null, "unknown").otherwise(F.col("status"))).drop("status")


def nested_intervals(tree: DataFrame) -> DataFrame:
    """dfs_left and dfs_right of every row of a tree (source_id, path), children in the order of their paths.

    left = 2 * position - 1 - depth and right = left + 2 * size - 1, from the preorder position (from 1),
    depth and subtree size: no recursion. The position is counted within a source, by ranges of its paths.
    """
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    rows = tree.select("source_id", "path", parts.alias("parts"))
    sizes = rows.select("source_id", F.explode(F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.array_append(ancestors("path"), F.col("path")))).alias("path")).groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("subtree"))
    # paths in the order of their parts: a separator comes before any character of a name
    numbered = sum_before(rows, ["source_id"], F.translate("path", "/", "\0"), F.lit(1), "earlier")
    left = (2 * (F.col("earlier") + 1) - 1 - F.size("parts")).cast("long")
    return numbered.join(sizes, ["source_id", "path"]).select("source_id", "path", left.alias("dfs_left"), (left + 2 * F.col("subtree") - 1).alias("dfs_right"))


def observation_status(entries: DataFrame) -> DataFrame:
    """Per source: unavailable, partial or complete, from counts of errors, vanished rows and the source's state."""
    return entries.select("source_id", F.when(~F.col("available"), "unavailable").when((F.col("error_count") > 0) | (F.col("vanished_count") > 0) | F.col("cancelled"), "partial").otherwise("complete").alias("status"))


def run_status(observations: DataFrame) -> DataFrame:
    """One row: failed if every source is unavailable, partial if any is not complete, else complete."""
    return observations.agg(F.when(F.bool_and(F.col("status") == "unavailable"), "failed").when(F.bool_or(F.col("status") != "complete"), "partial").otherwise("complete").alias("run_status"))


def section_quality(observations: DataFrame) -> DataFrame:
    return observations.agg(F.when(F.bool_and(F.col("status") == "unavailable"), "unavailable").when(F.bool_or(F.col("status") != "complete"), "partial").otherwise("complete").alias("quality"))
