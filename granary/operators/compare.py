"""Differences between two report snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_COLUMNS = ("size_bytes", "allocated_bytes_estimate", "mtime_sec", "mtime_nsec", "atime_sec", "atime_nsec", "uid", "category_id", "extension")


#: Fixed names of what makes two reports incomparable.
REASONS = {
    "profile_id": "different_profile",
    "scope_fingerprint": "scope_fingerprint_mismatch",
    "classification_version": "classification_version_mismatch",
    "source_identities": "source_identity_or_availability_mismatch",
}


def not_comparable(left: dict, right: dict) -> list[str]:
    """Why two reports can't be compared; ValueError if one failed."""
    for r in (left, right):
        if r["status"] == "failed":
            raise ValueError("a failed report has nothing to compare")
    reasons = [reason for key, reason in REASONS.items() if left.get(key) != right.get(key)]
    return reasons + ["partial_report"] * (left["status"] != "succeeded" or right["status"] != "succeeded")


def comparability(pairs: DataFrame) -> DataFrame:
    """pairs (columns left and right, structs of a report) with comparable and reasons, as :func:`not_comparable` gives them; a pair with a failed report is not comparable and has no reasons."""
    of = lambda side, key: F.col(f"{side}.{key}")
    found = [F.when(~of("left", key).eqNullSafe(of("right", key)), reason) for key, reason in REASONS.items()]
    partial = F.when((of("left", "status") != "succeeded") | (of("right", "status") != "succeeded"), "partial_report")
    failed = (of("left", "status") == "failed") | (of("right", "status") == "failed")
    reasons = F.when(failed, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found, partial)))
    return pairs.withColumns({"reasons": reasons, "comparable": ~failed & (F.size(reasons) == 0)})


def snapshot_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, deltas: list[str] = ()) -> DataFrame:
    """Rows added, removed or changed, with both sides and the deltas of some values.

    Keys are matched null-safely: a null key is a group like any other. It is encoded as a pair of
    non-null columns, so the full outer join stays an equi-join that is hashed or merged by key.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        matched = [c for k in keys for c in (F.col(k).isNull().alias(f"__null_{k}"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__key_{k}"))]
        return df.select(*matched, F.struct(*keys, *values).alias(name))

    on = [x for k in keys for x in (f"__null_{k}", f"__key_{k}")]
    j = side(left, "before").join(side(right, "after"), on, "full_outer")
    change: Column = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"before.{v}").eqNullSafe(F.col(f"after.{v}"))
    j = j.withColumn("change", change.when(differs, "changed")).filter(F.col("change").isNotNull())
    shown = [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys]
    delta = [(F.col(f"after.{v}").cast("decimal(38,0)") - F.col(f"before.{v}").cast("decimal(38,0)")).alias(f"delta_{v}") for v in deltas]
    return j.select(*shown, "change", "before", "after", *delta)


def publish_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int, folder: str) -> DataFrame:
    """A section as a catalogue table in ``folder``, dealt into buckets by its keys: two such tables are compared without moving a row.

    All sections to be compared with each other take the same number of buckets.
    """
    rows.repartition(buckets, *keys).write.option("path", folder).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)


def bucketed_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Like :func:`snapshot_diff` for tables of :func:`publish_bucketed`: each bucket meets its own, nothing is exchanged. Keys must not be null."""
    sides = [df.select(*keys, F.struct(*values).alias(name)) for df, name in ((left, "before"), (right, "after"))]
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"before.{v}").eqNullSafe(F.col(f"after.{v}"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(differs, "changed")
    return sides[0].join(sides[1], keys, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())


def row_key(section: str) -> Column:
    """The text key of a difference."""
    return {
        "folders": F.concat_ws(":", "source_id", F.lower(F.hex(F.col("path")))),
        "files": F.concat_ws(":", "source_id", F.lower(F.hex(F.col("path")))),
        "owners": F.concat_ws(":", "source_id", F.coalesce(F.col("uid").cast("string"), F.lit("unknown"))),
        "categories": F.concat_ws(":", "source_id", "category_id"),
    }[section]


def change_counts(diffs: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each section changed in which way."""
    parts = [d.groupBy(F.lit(name).alias("section"), "change").agg(F.count(F.lit(1)).alias("n")) for name, d in diffs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison_rows(diffs: dict[str, DataFrame]) -> DataFrame:
    """The differences of all sections as section, row_key and change."""
    out = None
    for name, d in diffs.items():
        rows = d.select(F.lit(name).alias("section"), row_key(name).alias("row_key"), "change")
        out = rows if out is None else out.unionByName(rows)
    return out


def comparison_page(rows: DataFrame, limit: int, *, section: str | None = None, after: tuple[str, str] | None = None) -> DataFrame:
    """A page by (section, row_key), of one section or all, after the last row of the page before."""
    if section is not None:
        rows = rows.filter(F.col("section") == section)
    if after is not None:
        rows = rows.filter((F.col("section") > after[0]) | ((F.col("section") == after[0]) & (F.col("row_key") > after[1])))
    return rows.orderBy("section", "row_key").limit(limit)
