"""Trees that are known by parent ids only: paths, and what lies below a directory.

Spark's recursive queries go a level a step and stop at fixed limits of depth and rows. Here every directory
keeps a pointer that is doubled: after k rounds it points 2^k levels up and knows what lies between, so the
rounds grow as the logarithm of the depth. Only directories take part; files join theirs once at the end. A round
joins the directories that are not done with the table of all, by id, and is written before the next.

Defined cases: a row without a parent is a root (its path is empty); a directory whose ancestors lead to an id that
is not there, or round in a circle, has no path; what lies below a
directory is what its pointers meet, circles included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.stages import stage


def _joined_path(above: Column, below: Column) -> Column:
    return F.when(above == "", below).when(below == "", above).otherwise(F.concat(above, F.lit("/"), below))


def _doubled(state: DataFrame, carried: dict, done: Column) -> tuple[DataFrame, int]:
    """Doubles the pointer ``up`` of rows that are not ``done`` until all are or nothing can change; ``carried``: column to (own, above) -> new."""
    state, rounds = stage(state, "pointers"), 0
    limit = state.count().bit_length() + 1  # no tree of so many rows is deeper; only circles go on
    while rounds < limit and not state.filter(~done).isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up_2"), *(F.col(c).alias(f"{c}_2") for c in carried))
        moved = state.filter(~done).join(above, "up", "left")
        step = moved.select("id", *(f(F.col(c), F.col(f"{c}_2")).alias(c) for c, f in carried.items()), F.col("up_2").alias("up"))
        state, rounds = stage(state.filter(done).select("id", *carried, "up").unionByName(step), "pointers"), rounds + 1
    return state, rounds


def with_paths(entries: DataFrame, name: str = "display_name") -> DataFrame:
    """entries (entry_id, parent_entry_id, entry_kind, a name) with path and depth; null where a chain of parents does not reach a root."""
    folders = entries.filter(F.col("entry_kind") == "directory").select(
        F.col("entry_id").alias("id"), F.col("parent_entry_id").alias("up"), F.when(F.col("parent_entry_id").isNull(), "").otherwise(F.col(name)).alias("path"),
        F.when(F.col("parent_entry_id").isNull(), 0).otherwise(1).alias("depth"),
    )
    # circles would double their paths for ever: which rows reach a root is found first, on pointers alone
    reach, _ = _doubled(folders.select("id", "up", F.lit(True).alias("rooted")), {"rooted": lambda own, above: own & F.coalesce(above, F.lit(False))}, F.col("up").isNull())
    rooted = folders.join(reach.filter("up IS NULL AND rooted").select("id"), "id", "left_semi")
    known, _ = _doubled(rooted, {"path": lambda own, above: _joined_path(above, own), "depth": lambda own, above: own + above}, F.col("up").isNull())
    above = known.select(F.col("id").alias("parent_entry_id"), F.col("path").alias("above"), (F.col("depth") + 1).alias("level"))
    out = entries.drop("path", "depth").join(above, "parent_entry_id", "left")
    root = F.col("parent_entry_id").isNull()
    return out.withColumns({"path": F.when(root, "").otherwise(_joined_path(F.col("above"), F.col(name))), "depth": F.when(root, 0).otherwise(F.col("level"))}).drop("above", "level")


def subtree_by_ids(entries: DataFrame, directory_id: int) -> DataFrame:
    """A directory and all that lies below it, from parent ids alone; ValueError if the id is not one of a directory."""
    folders = entries.filter(F.col("entry_kind") == "directory")
    if folders.filter(F.col("entry_id") == directory_id).isEmpty():
        raise ValueError(f"{directory_id} is not a directory")
    start = folders.select(F.col("entry_id").alias("id"), F.col("parent_entry_id").alias("up"), (F.col("entry_id") == directory_id).alias("inside"))
    known, _ = _doubled(start, {"inside": lambda own, above: own | F.coalesce(above, F.lit(False))}, F.col("inside") | F.col("up").isNull())
    inside = known.filter("inside").select(F.col("id").alias("parent_entry_id"))
    below = entries.filter(F.col("entry_id") != directory_id).join(inside, "parent_entry_id", "left_semi")
    return below.select(*entries.columns).unionByName(entries.filter(F.col("entry_id") == directory_id))


def store_intervals(nodes: DataFrame, folder: str) -> DataFrame:
    """nodes (source_id, dfs_left, dfs_right and more) as a table in ranges of (source_id, dfs_left): a subtree is one stretch of its files."""
    nodes.repartitionByRange("source_id", "dfs_left").sortWithinPartitions("source_id", "dfs_left").write.parquet(folder)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(folder)


def subtree_by_interval(stored: DataFrame, source_id: str, directory: str) -> DataFrame:
    """A directory of a source and all below it: one range of dfs_left, which the scan uses to leave files and row groups unread."""
    own = stored.filter((F.col("source_id") == source_id) & (F.col("path") == directory)).select("dfs_left", "dfs_right").first()
    if own is None:
        raise ValueError(f"{directory!r} is not in {source_id}")
    return stored.filter((F.col("source_id") == source_id) & (F.col("dfs_left") >= own["dfs_left"]) & (F.col("dfs_left") <= own["dfs_right"]))
