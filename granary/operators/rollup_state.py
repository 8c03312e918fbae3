"""Directory rollups that are kept up with changes instead of computed anew.

The state of a directory is sums and counts, also of unknown values, so that they can be taken back: a total is
null while a count of unknowns is above zero, and heals when it returns to zero. A change is the
rows that go and the rows that come (a changed file is in both). Signed sums are taken by directory, spread over
the ancestors, and added to the old state; only directories above a change are touched by the spreading.

Unique and allocated bytes belong to the first occurrence of an identity, which a change elsewhere can move.
So the identities that a change touches are looked up in the old files, and the shares of their first
occurrences are taken back and given anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.expressions import ancestors, parent
from granary.operators.aggregates import directories
from granary.sources.stages import stage

ROW = ("entry_id", "source_id", "path", "size_bytes", "allocated_bytes_estimate", "file_identity_key")
_BY_FILE = ("files", "logical", "unknown_logical", "unknown_unique", "unknown_allocated")
_SUMS = (*_BY_FILE, "uniq", "alloc")


def _shares(rows: DataFrame, sign: int) -> DataFrame:
    """What files give to their directory, whichever occurrence they are."""
    size, key, allocated = F.col("size_bytes"), F.col("file_identity_key"), F.col("allocated_bytes_estimate")
    values = {
        "files": F.lit(1), "logical": F.coalesce(size, F.lit(0)), "unknown_logical": size.isNull().cast("long"),
        "unknown_unique": (key.isNull() | size.isNull()).cast("long"), "unknown_allocated": (key.isNull() | allocated.isNull()).cast("long"), "uniq": F.lit(0), "alloc": F.lit(0),
    }
    return rows.select("source_id", parent("path").alias("dir"), *((sign * v).cast("long").alias(c) for c, v in values.items()))


def _first_shares(rows: DataFrame, sign: int) -> DataFrame:
    """What the first occurrences among rows give to their directories."""
    known = rows.filter(F.col("file_identity_key").isNotNull())
    first = known.groupBy("file_identity_key").agg(F.min("entry_id").alias("entry_id")).select("entry_id")
    own = known.join(first, "entry_id", "left_semi")
    zero = [F.lit(0).cast("long").alias(c) for c in _BY_FILE]
    return own.select("source_id", parent("path").alias("dir"), *zero, *((sign * F.coalesce(c, F.lit(0))).cast("long").alias(n) for n, c in (("uniq", F.col("size_bytes")), ("alloc", F.col("allocated_bytes_estimate")))))


def _spread(shares: DataFrame) -> DataFrame:
    by_dir = shares.groupBy("source_id", "dir").agg(*(F.sum(c).alias(c) for c in _SUMS))
    up = by_dir.withColumn("path", F.explode(F.array_append(ancestors("dir"), F.col("dir"))))
    return up.groupBy("source_id", "path").agg(*(F.sum(c).alias(c) for c in _SUMS))


def rollup_state(files: DataFrame) -> DataFrame:
    """source_id, path, the sums and counts of everything below, and dir_count."""
    rows = files.select(*ROW)
    inner = directories(rows).filter(F.col("path") != "").select("source_id", F.explode(ancestors("path")).alias("path")).groupBy("source_id", "path").agg(F.count(F.lit(1)).alias("dir_count"))
    sums = _spread(_shares(rows, 1).unionByName(_first_shares(rows, 1)))
    return sums.join(inner, ["source_id", "path"], "left").withColumn("dir_count", F.coalesce("dir_count", F.lit(0).cast("long")))


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that go and the rows that come between two tables of files (unique by entry_id)."""
    old, new = before.select(*ROW), after.select(*ROW)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ROW[1:]]
    on = F.col("l.entry_id") == F.col("r.entry_id")
    for c in same:
        on = on & c
    gone, come = old.alias("l").join(new.alias("r"), on, "left_anti"), new.alias("l").join(old.alias("r"), on, "left_anti")
    return stage(gone, "gone"), stage(come, "come")  # each is read three times


def rollup_difference(before: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Signed sums for every directory above a change."""
    gone, come = removed.select(*ROW), added.select(*ROW)
    touched = gone.unionByName(come).select("file_identity_key").filter(F.col("file_identity_key").isNotNull()).distinct()
    held = stage(before.select(*ROW).join(touched, "file_identity_key", "left_semi").select(*ROW), "touched-identities")
    now = held.join(gone.select("entry_id"), "entry_id", "left_anti").select(*ROW).unionByName(come)
    return _spread(_shares(gone, -1).unionByName(_shares(come, 1)).unionByName(_first_shares(held, -1)).unionByName(_first_shares(now, 1)))


def apply_difference(state: DataFrame, difference: DataFrame) -> DataFrame:
    """The state after a difference. Directories without a file left go; those born or gone count in the dir_count of all above."""
    both = state.withColumn("was", F.col("files")).unionByName(difference.withColumns({"dir_count": F.lit(0).cast("long"), "was": F.lit(0).cast("long")}))
    merged = stage(both.groupBy("source_id", "path").agg(*(F.sum(c).alias(c) for c in (*_SUMS, "dir_count", "was"))), "rollup")
    turned = F.when((F.col("was") == 0) & (F.col("files") > 0), 1).when((F.col("was") > 0) & (F.col("files") == 0), -1)
    moved = merged.select("source_id", "path", turned.alias("n")).filter(F.col("n").isNotNull() & (F.col("path") != ""))
    above = moved.select("source_id", F.explode(ancestors("path")).alias("path"), "n").groupBy("source_id", "path").agg(F.sum("n").alias("n"))
    out = merged.filter("files > 0").join(above, ["source_id", "path"], "left")
    return out.withColumn("dir_count", F.col("dir_count") + F.coalesce("n", F.lit(0))).drop("n", "was")


def rollup_view(state: DataFrame) -> DataFrame:
    """The state as :func:`granary.operators.aggregates.directory_rollup` gives it: unknown totals are null."""
    known = lambda c, unknown: F.when(F.col(unknown) == 0, F.col(c))
    return state.select(
        "source_id", "path", F.col("files").alias("file_count"), known("logical", "unknown_logical").alias("logical_bytes"), known("uniq", "unknown_unique").alias("unique_bytes"),
        known("alloc", "unknown_allocated").alias("allocated_bytes"), "dir_count",
    )
