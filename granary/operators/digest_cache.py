"""Digests kept from run to run, so that a run reads only what is new or has changed.

The cache is a table in a folder, partitioned by run: cache_key, sample_hash, full_sha256. A key names a file's
identity, size and times (:func:`granary.functions.expressions.hash_cache_key`), never its path or inode alone, so a changed
file has another key. A run looks its candidates up by key, asks the contents for the keys that nobody knows, one
entry for each (hard links share a key), and appends what it has read. Nothing is rewritten; a run that is repeated
replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from granary.functions import expressions as X
from granary.operators.duplicates import ContentTable, survivors
from granary.sources.stages import stage

_SCHEMA = "cache_key string, sample_hash string, full_sha256 string, run string"


class DigestCache:
    """The digests that earlier runs have left in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def known(self, without_run: str | None = None) -> DataFrame:
        """One row for each key: digests of one key are equal, whichever run has read them."""
        try:
            rows = self.spark.read.schema(_SCHEMA).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _SCHEMA)
        if without_run is not None:
            rows = rows.filter(F.col("run") != without_run)
        return rows.groupBy("cache_key").agg(F.max("sample_hash").alias("sample_hash"), F.max("full_sha256").alias("full_sha256"))

    def add(self, read: DataFrame, run: str) -> None:
        """Appends what a run has read; a repeated run replaces only its own rows."""
        read.select("cache_key", "sample_hash", "full_sha256", F.lit(run).alias("run")).write.partitionBy("run").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)

    def hashed(self, found: DataFrame, contents: ContentTable, run: str, *, region: int = X.SAMPLE_REGION, threshold: int = X.SAMPLE_THRESHOLD) -> DataFrame:
        """Like :func:`granary.operators.duplicates.hashed` for candidates with a cache_key; also was_read: whether this run has read the file's key.

        A null cache_key (an unknown time) is never looked up nor kept: such a file is read in every run.
        """
        known = stage(self.known(run), "known-digests")
        looked = stage(found.join(known, "cache_key", "left"), "looked-up")
        once = F.coalesce("cache_key", F.concat(F.lit("entry:"), F.col("entry_id").cast("string")))
        looked = looked.withColumn("asked", once)
        new_samples = stage(self._read(looked.filter((F.col("size_bytes") > threshold) & F.col("sample_hash").isNull() & F.col("full_sha256").isNull()), lambda e: contents.samples(e, region, threshold), "sample_hash"), "new-samples")
        sampled = stage(looked.join(new_samples, "asked", "left").withColumn("sample_hash", F.coalesce("new", "sample_hash")).drop("new"), "samples")
        left = survivors(sampled, threshold)
        new_digests = stage(self._read(left.filter(F.col("full_sha256").isNull()), contents.digests, "full_sha256"), "new-digests")
        fresh = new_samples.withColumnRenamed("new", "sample_hash").join(new_digests.withColumnRenamed("new", "full_sha256"), "asked", "full_outer")
        self.add(fresh.filter(~F.col("asked").startswith("entry:")).withColumnRenamed("asked", "cache_key"), run)
        out = left.join(new_digests, "asked", "left").join(new_samples.select("asked", F.lit(True).alias("sample_read")), "asked", "left")
        was_read = F.col("new").isNotNull() | F.coalesce("sample_read", F.lit(False))
        return stage(out.withColumn("was_read", was_read).withColumn("full_sha256", F.coalesce("full_sha256", "new")).drop("new", "asked", "sample_read"), "digests")

    @staticmethod
    def _read(wanted: DataFrame, read, name: str) -> DataFrame:
        """asked and new, from one entry for each key."""
        one = wanted.groupBy("asked").agg(F.min("entry_id").alias("entry_id"))
        return read(one).join(one, "entry_id").select("asked", F.col(name).alias("new")).filter(F.col("new").isNotNull())
