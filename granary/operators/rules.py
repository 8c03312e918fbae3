"""Include and exclude rules over paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.expressions import components, glob_regex, parent

# Names excluded always (an application's own trees), and by the preset for system folders.
FORCED_NAMES = ("runs", "reports", "exports", "cache", "secrets", "config-backups")
PRESET_NAMES = ("@eaDir", "#recycle", "$RECYCLE.BIN")


@dataclass(frozen=True)
class PathRules:
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    include_hidden: bool = False
    preset: bool = True
    forced: tuple[str, ...] = FORCED_NAMES

    def reason(self, path: Column | str, is_dir: Column) -> Column:
        """Why an entry is left out, or null: the first component that forces, is preset or hidden; then globs; includes hold for files only."""
        path = F.col(path) if isinstance(path, str) else path
        parts = components(path)

        def of(c: Column) -> Column:
            out = F.when(c.isin(*self.forced), "system_forced") if self.forced else F.when(F.lit(False), "")
            if self.preset:
                out = out.when(c.isin(*PRESET_NAMES), "system_preset")
            if not self.include_hidden:
                out = out.when(c.startswith("."), "hidden")
            return out

        by_name = F.get(F.array_compact(F.transform(parts, of)), 0)
        name = F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts), -1), F.lit(""))

        def matches(globs: tuple[str, ...]) -> Column:
            out = F.lit(False)
            for g in globs:
                out = out | path.rlike(glob_regex(g)) | (name.rlike(glob_regex(g)) if "/" not in g else F.lit(False))
            return out

        by_glob = F.when(matches(self.exclude), "exclude_glob")
        if self.include:
            by_glob = by_glob.when(~is_dir & ~matches(self.include), "not_included")
        return F.when(path == "", F.lit(None).cast("string")).otherwise(F.coalesce(by_name, by_glob))

    def split(self, entries: DataFrame, is_dir: Column) -> tuple[DataFrame, DataFrame]:
        """The entries that stay, and those left out with their reason."""
        marked = entries.withColumn("excluded_reason", self.reason("path", is_dir))
        return marked.filter(F.col("excluded_reason").isNull()).drop("excluded_reason"), marked.filter(F.col("excluded_reason").isNotNull())


def excluded_by_directory(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("source_id", parent("path").alias("path")).agg(F.count(F.lit(1)).alias("excluded_count"))


def keep_kinds(entries: DataFrame, policy: str) -> DataFrame:
    """``regular_only`` keeps files and directories; ``all_metadata`` keeps all, without sizes for others."""
    if policy == "regular_only":
        return entries.filter(F.col("entry_kind").isin("regular_file", "directory"))
    return entries.withColumn("size_bytes", F.when(F.col("entry_kind") == "regular_file", F.col("size_bytes")))
