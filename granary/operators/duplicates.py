"""Content duplicates among files: from sizes over samples to whole contents.

Stages, each keeping what the next has to read small: sizes with two identities or more; candidate
keys; sample fingerprints of large files; whole contents only where a peer shares the sample; groups.
Sizes and identities come first, from a table without contents. What a stage leaves is written as a narrow
table (entry_id, size, key, identity, digests) that the next stages read, so plans do not nest. Contents are
read through an object with two methods, ``samples`` and ``digests``, that get the entries to read; those of a
digest cache (:mod:`granary.operators.digest_cache`) are asked only for what no earlier run has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import expressions as X
from granary.operators.file_query import clamped
from granary.operators.ranges import sum_before
from granary.sources.stages import stage


class ContentTable:
    """Contents as a table (entry_id, content).

    Such a table is scanned whole whichever entries are asked for, so digests are taken where it is scanned: what a join
    moves are digests, never contents.
    """

    def __init__(self, contents: DataFrame):
        self.contents = contents

    def samples(self, entries: DataFrame, region: int, threshold: int) -> DataFrame:
        """entry_id and sample_hash of the entries (each once)."""
        found = self.contents.select("entry_id", X.sample_fingerprint("content", region=region, threshold=threshold).alias("sample_hash"))
        return found.filter(F.col("sample_hash").isNotNull()).join(entries.select("entry_id"), "entry_id")

    def digests(self, entries: DataFrame) -> DataFrame:
        """entry_id and full_sha256 of the entries (each once)."""
        return self.contents.select("entry_id", X.content_sha256("content").alias("full_sha256")).join(entries.select("entry_id"), "entry_id")


def size_buckets(files: DataFrame, minimum: int = 1, maximum: int | None = None) -> DataFrame:
    """Sizes that two identities or more have."""
    s = F.col("size_bytes")
    rows = files.filter((s >= minimum) & (s <= maximum if maximum is not None else F.lit(True)))
    ids = rows.select("size_bytes", "file_identity_key").filter(F.col("file_identity_key").isNotNull()).distinct()
    return ids.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("identities")).filter("identities > 1")


def candidates(files: DataFrame, *, minimum: int = 1, maximum: int | None = None, same_name: bool = False, same_mtime: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Files with an identity in a size bucket: entry_id, size_bytes, file_identity_key, candidate_key and ``keep``, as a stage table. No content is read."""
    s = F.col("size_bytes")
    known = files.filter(F.col("file_identity_key").isNotNull() & (s >= minimum) & (s <= maximum if maximum is not None else F.lit(True)))
    sizes = stage(known.select("entry_id", "size_bytes", "file_identity_key", candidate_key_of(same_name, same_mtime).alias("candidate_key"), *keep), "sizes")
    shared = stage(size_buckets(sizes).select("size_bytes"), "shared-sizes")  # of known size: sent to all tasks if small, else joined with hot sizes split
    return stage(sizes.join(shared, "size_bytes", "left_semi"), "candidates")


def candidate_key_of(same_name: bool, same_mtime: bool) -> Column:
    return X.candidate_key(F.col("size_bytes"), F.col("display_name") if same_name else None, (F.col("mtime_sec"), F.col("mtime_nsec")) if same_mtime else None)


def sampled(found: DataFrame, contents: DataFrame | ContentTable, *, region: int = X.SAMPLE_REGION, threshold: int = X.SAMPLE_THRESHOLD) -> DataFrame:
    """found with sample_hash, as a stage table: the sample of files over the threshold, null for the others. Only the large ones are read."""
    large = found.filter(F.col("size_bytes") > threshold).select("entry_id")
    return stage(found.join(_readable(contents).samples(large, region, threshold), "entry_id", "left"), "samples")


def hashed(found: DataFrame, contents: DataFrame | ContentTable, *, region: int = X.SAMPLE_REGION, threshold: int = X.SAMPLE_THRESHOLD) -> DataFrame:
    """Those of found that may have an equal, with sample_hash and full_sha256, as a stage table: whole contents are read of survivors only."""
    left = survivors(sampled(found, contents, region=region, threshold=threshold), threshold)
    return stage(left.join(_readable(contents).digests(left), "entry_id"), "digests")


def _readable(contents: DataFrame | ContentTable) -> ContentTable:
    return ContentTable(contents) if isinstance(contents, DataFrame) else contents


def skip_reason(available: Column, metadata_only: Column, remote: Column, over_budget: Column) -> Column:
    """The first reason that holds, or null."""
    return F.when(~available, "source_unavailable").when(metadata_only, "metadata_only").when(remote, "remote_content_disallowed").when(over_budget, "hash_budget_exceeded")


def within_budget(found: DataFrame, budget: int, ranges: int = 64) -> DataFrame:
    """Adds within_budget: whether the running total of bytes, by size and entry, stays inside the budget.

    The total over smaller sizes comes from sums by size, the rest from files of equal size; both in ranges, so
    that neither all sizes nor all files of one size are ordered in one task.
    """
    sums = found.groupBy("size_bytes").agg(F.sum("size_bytes").alias("bytes")).withColumn("all", F.lit(0))
    before = sum_before(sums, ["all"], F.col("size_bytes"), F.col("bytes"), "before", ranges).select("size_bytes", "before")
    own = sum_before(found, ["size_bytes"], F.col("entry_id"), F.col("size_bytes"), "own", ranges)
    return own.join(before, "size_bytes").withColumn("within_budget", F.col("before") + F.col("own") + F.col("size_bytes") <= budget).drop("before", "own")


def survivors(found: DataFrame, threshold: int = X.SAMPLE_THRESHOLD) -> DataFrame:
    """Candidates to hash in full: small ones, those without a sample, and those whose sample a peer shares."""
    keys = ["size_bytes", "candidate_key", "sample_hash"]
    shared = found.filter(F.col("sample_hash").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").withColumn("shared", F.lit(True))
    return found.join(shared, keys, "left").filter((F.col("size_bytes") <= threshold) | F.col("sample_hash").isNull() | F.col("shared")).drop("shared")


def groups(found: DataFrame, listed: int = 1000) -> DataFrame:
    """Groups of equal content: members, distinct identities, redundant bytes."""
    keys, listed = ["size_bytes", "candidate_key", "full_sha256"], clamped("listed", listed)
    per_identity = found.groupBy(*keys, "file_identity_key").agg(F.count(F.lit(1)).alias("n"))
    g = per_identity.groupBy(*keys).agg(F.sum("n").alias("member_count"), F.count(F.lit(1)).alias("identities")).filter("identities > 1")
    return g.select(
        "size_bytes", "candidate_key", F.col("full_sha256").alias("sha256"), "member_count", "identities", F.least("member_count", F.lit(listed)).alias("listed_member_count"),
        ((F.col("identities") - 1) * F.col("size_bytes")).alias("logical_redundancy_bytes"), (F.col("member_count") > listed).alias("truncated"),
        F.when(F.col("member_count") > listed, "hash_incomplete").otherwise("hash_complete").alias("verification"),
    )


def members(found: DataFrame, group_table: DataFrame, listed: int = 1000) -> DataFrame:
    """The first members of each group by entry_id, and whether an earlier member is the same file."""
    listed = clamped("listed", listed)
    g = group_table.select("size_bytes", "candidate_key", F.col("sha256").alias("full_sha256"))
    rows = found.join(g, ["size_bytes", "candidate_key", "full_sha256"], "left_semi")
    alias = with_alias_flag(rows)
    place = F.row_number().over(Window.partitionBy("size_bytes", "candidate_key", "full_sha256").orderBy("entry_id"))
    return alias.withColumn("place", place).filter(F.col("place") <= listed).select(F.col("full_sha256").alias("sha256"), "entry_id", "is_hardlink_alias")


def member_details(listed: DataFrame, files: DataFrame, digests: DataFrame) -> DataFrame:
    """Members with their entries, and what is known of their digests (null where nothing is): entry_id, sample_hash, full_sha256."""
    return listed.join(files, "entry_id").join(digests.select("entry_id", "sample_hash", "full_sha256"), "entry_id", "left")


def with_alias_flag(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("file_identity_key").agg(F.min("entry_id").alias("first_id"))
    return rows.join(first, "file_identity_key").withColumn("is_hardlink_alias", F.col("entry_id") > F.col("first_id")).drop("first_id")


def redundancy_total(group_table: DataFrame) -> DataFrame:
    return group_table.agg(F.count(F.lit(1)).alias("group_count"), F.sum(F.col("logical_redundancy_bytes").cast("decimal(38,0)")).alias("redundant_bytes"))


def cleanup_blocked(protected: Column, nlink: Column, kind: Column, same_hash: Column, present: Column, changed: Column) -> Column:
    """The first reason why a member may not be removed, or null."""
    return (
        F.when(protected, "protected").when(nlink > 1, "hardlink").when(kind == "symlink", "symlink").when(kind != "regular_file", "not_regular")
        .when(~same_hash, "hash_mismatch").when(~present, "missing").when(changed, "changed")
    )
