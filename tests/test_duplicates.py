"""Stage tables and the digest cache."""

import pytest
from pyspark.sql import functions as F

from granary import registry
from granary.functions import expressions as X
from granary.operators import duplicates as D
from granary.operators.digest_cache import DigestCache

REGION, THRESHOLD = 8, 40


class Counting(D.ContentTable):
    """Notes which entries are read."""

    def __init__(self, contents):
        super().__init__(contents)
        self.sampled, self.read = [], []

    def samples(self, entries, region, threshold):
        self.sampled += sorted(r["entry_id"] for r in entries.collect())
        return super().samples(entries, region, threshold)

    def digests(self, entries):
        self.read += sorted(r["entry_id"] for r in entries.collect())
        return super().digests(entries)


@pytest.mark.parametrize("name,most", [("a13_duplicate_groups", 8), ("d8_duplicate_members", 12), ("j7_member_details", 14), ("d4_sample_survivors", 8)])
def test_plans_do_not_nest(spark, small, name, most):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation ") <= most


def files(spark, rows):
    """rows: entry_id, inode, content, mtime."""
    df = spark.createDataFrame([(i, n, c, m) for i, n, c, m in rows], "entry_id long, inode long, content string, mtime_sec long")
    size = F.octet_length("content").cast("long")
    key = X.hash_cache_key(F.lit(1), F.lit(1), F.col("inode"), size, (F.col("mtime_sec"), F.lit(0)), (F.col("mtime_sec"), F.lit(0)))
    return df.select("*", size.alias("size_bytes"), F.concat(F.lit("1:"), F.col("inode")).alias("file_identity_key"), key.alias("cache_key"))


def test_second_run_reads_only_what_changed(spark, tmp_path):
    cache = DigestCache(spark, str(tmp_path / "cache"))
    large, other = "x" * 50, "y" * 50
    first = [(1, 1, "abc", 5), (2, 2, "abc", 5), (3, 2, "abc", 5), (4, 4, "abd", 5), (5, 5, large, 5), (6, 6, large, 5), (7, 7, other, 5), (8, 8, "alone", 5), (9, 9, "abc", None)]

    def run(rows, name):
        f = files(spark, rows)
        contents = Counting(f.select("entry_id", "content"))
        found = D.candidates(f, keep=("cache_key",))
        out = cache.hashed(found, contents, name, region=REGION, threshold=THRESHOLD)
        if name in ("r1", "r4"):
            plain = D.hashed(found, f.select("entry_id", "content"), region=REGION, threshold=THRESHOLD)
            assert sorted(map(tuple, out.select("entry_id", "sample_hash", "full_sha256").collect())) == sorted(map(tuple, plain.select("entry_id", "sample_hash", "full_sha256").collect()))
        return contents, out

    c, _ = run(first, "r1")
    assert c.sampled == [5, 6, 7] and c.read == [1, 2, 4, 5, 6, 9]  # one entry of the two names of inode 2; 7 has a sample of its own
    c, out = run(first, "r2")
    assert c.sampled == [] and c.read == [9]  # the time of 9 is not known: it has no key
    assert {r["entry_id"] for r in out.filter("was_read").collect()} == {9}
    changed = [(i, n, "abz" if i == 4 else c, 6 if i == 4 else m) for i, n, c, m in first if i != 9]
    c, out = run(changed, "r3")
    assert c.sampled == [] and c.read == [4]
    like_other = [*changed, (10, 10, other, 5)]
    c, _ = run(like_other, "r4")
    assert c.sampled == [10] and c.read == [7, 10]  # the sample of 7 is known, its digest was never needed
    c, _ = run(like_other, "r4")  # a run again: its own rows do not count as known
    assert c.sampled == [10] and c.read == [7, 10]
