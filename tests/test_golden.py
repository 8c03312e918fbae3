"""A tree of three sources, four folders deep, whose figures follow from the rules of the operators by hand.

alpha  a/b/c/d/deep.bin 40 (identity 1)      a/b/c/d/copy.bin 40 (2, equal)    a/b/one.csv 7 (3)     a/b/unknown.csv size not known, no identity
beta   x/deep-link.bin 40 (1: a hard link into alpha)    x/y/z/w/seven.csv 7 (4, equal to one.csv)    x/y/seven-2.csv 7 (5, equal)    top.txt 12 (6)
gamma  m/same.iso 90 (7)    m/same-link.iso 90 (7)    m/n/o/p/same-again.iso 90 (7)    m/other.iso 55 (8)    m/n/empty.txt 0 (9)

Groups: 40 bytes (three members, two identities) and 7 bytes (three members, three identities). The three names
of identity 7 have equal content, but are one file: no group.
"""

import pytest
from pyspark.sql import functions as F

from granary.functions.expressions import classify
from granary.operators import aggregates as A
from granary.operators import duplicates as D

FILES = [
    (1, "alpha", "a/b/c/d/deep.bin", "Q" * 40, 1), (2, "alpha", "a/b/c/d/copy.bin", "Q" * 40, 2), (3, "alpha", "a/b/one.csv", "1;2;3;4", 3), (4, "alpha", "a/b/unknown.csv", None, None),
    (5, "beta", "x/deep-link.bin", "Q" * 40, 1), (6, "beta", "x/y/z/w/seven.csv", "1;2;3;4", 4), (7, "beta", "x/y/seven-2.csv", "1;2;3;4", 5), (8, "beta", "top.txt", "twelve bytes", 6),
    (9, "gamma", "m/same.iso", "s" * 90, 7), (10, "gamma", "m/same-link.iso", "s" * 90, 7), (11, "gamma", "m/n/o/p/same-again.iso", "s" * 90, 7), (12, "gamma", "m/other.iso", "o" * 55, 8),
    (13, "gamma", "m/n/empty.txt", "", 9),
]


@pytest.fixture
def tree(spark):
    rows = [(i, s, p, p.split("/")[-1], c, None if c is None else len(c), None if c is None else -(-len(c) // 64) * 64, k and f"dev:{k}") for i, s, p, c, k in FILES]
    df = spark.createDataFrame(rows, "entry_id long, source_id string, path string, display_name string, content string, size_bytes long, allocated_bytes_estimate long, file_identity_key string")
    category, extension = classify("display_name")
    return df.select("*", category.alias("category_id"), extension.alias("extension"), F.lit("regular_file").alias("entry_kind"), F.lit(0).alias("mtime_sec"), F.lit(0).alias("mtime_nsec"), F.lit(1).alias("uid"))


def test_rollup(tree):
    """files, folders below, logical, unique and allocated bytes. An unknown size spoils every folder above it and no other."""
    r = {(x["source_id"], x["path"]): (x["file_count"], x["dir_count"], x["logical_bytes"], x["unique_bytes"], x["allocated_bytes"]) for x in A.directory_rollup(tree).collect()}
    assert r == {
        ("alpha", ""): (4, 4, None, None, None), ("alpha", "a"): (4, 3, None, None, None), ("alpha", "a/b"): (4, 2, None, None, None),
        ("alpha", "a/b/c"): (2, 1, 80, 80, 128), ("alpha", "a/b/c/d"): (2, 0, 80, 80, 128),
        # the link's bytes count where the identity occurs first: in alpha
        ("beta", ""): (4, 4, 66, 26, 192), ("beta", "x"): (3, 3, 54, 14, 128), ("beta", "x/y"): (2, 2, 14, 14, 128), ("beta", "x/y/z"): (1, 1, 7, 7, 64), ("beta", "x/y/z/w"): (1, 0, 7, 7, 64),
        ("gamma", ""): (5, 4, 325, 145, 192), ("gamma", "m"): (5, 3, 325, 145, 192), ("gamma", "m/n"): (2, 2, 90, 0, 0), ("gamma", "m/n/o"): (1, 1, 90, 0, 0), ("gamma", "m/n/o/p"): (1, 0, 90, 0, 0),
    }


def test_categories(tree):
    got = {(r["source_id"], r["category_id"]): (r["file_count"], r["logical_bytes"], r["allocated_bytes"]) for r in A.category_aggregate(tree).collect()}
    assert got[("gamma", "disk_images")] == (4, 325, 192) and sum(n for n, _, _ in got.values()) == 13
    (unknown,) = [k for k, (_, b, _) in got.items() if b is None]
    assert unknown == ("alpha", classify_of(tree, "unknown.csv"))


def classify_of(tree, name):
    return tree.filter(F.col("display_name") == name).first()["category_id"]


def test_duplicates(tree):
    found = D.candidates(tree)
    assert sorted(r["entry_id"] for r in found.collect()) == [1, 2, 3, 5, 6, 7]  # 90 bytes: one identity only
    whole = D.hashed(found, tree.select("entry_id", "content"))
    got = sorted((g["size_bytes"], g["member_count"], g["identities"], g["logical_redundancy_bytes"]) for g in D.groups(whole).collect())
    assert got == [(7, 3, 3, 14), (40, 3, 2, 40)]
    assert sorted((r["entry_id"], r["is_hardlink_alias"]) for r in D.members(whole, D.groups(whole)).collect()) == [(1, False), (2, False), (3, False), (5, True), (6, False), (7, False)]
    assert D.redundancy_total(D.groups(whole)).first()["redundant_bytes"] == 54


def test_intervals_nest(tree):
    nodes = A.directories(tree).unionByName(tree.select("source_id", "path"))
    got = {(r["source_id"], r["path"]): (r["dfs_left"], r["dfs_right"]) for r in A.nested_intervals(nodes).collect()}
    assert len(got) == 13 + 15 and got[("gamma", "")] == (1, 20)
    for (s, a), (la, ra) in got.items():
        for (t, b), (lb, rb) in got.items():
            if s == t:
                assert (la <= lb and rb <= ra) == (a == "" or b == a or b.startswith(a + "/"))


def test_no_files(tree):
    assert A.directory_rollup(tree.limit(0)).count() == 0 and D.groups(D.hashed(D.candidates(tree.limit(0)), tree.select("entry_id", "content"))).count() == 0


def test_samples_that_collide(spark):
    """Two large files that differ only between the sampled regions: their digests part them."""
    same, size = bytes(i % 251 for i in range(400_000)), 400_000
    other = same[:150_000] + b"?" + same[150_001:]
    rows = [(1, "a", same, "k1"), (2, "b", other, "k2"), (3, "c", same, "k3"), (4, "d", same[::-1], "k4")]
    df = spark.createDataFrame(rows, "entry_id long, display_name string, content binary, file_identity_key string").withColumn("size_bytes", F.lit(size).cast("long"))
    found = D.candidates(df.drop("content"))
    marked = D.sampled(found, df.select("entry_id", "content"))
    assert marked.select("sample_hash").distinct().count() == 2 and sorted(r["entry_id"] for r in D.survivors(marked).collect()) == [1, 2, 3]
    (g,) = D.groups(D.hashed(found, df.select("entry_id", "content"))).collect()
    assert g["member_count"] == 2


@pytest.mark.parametrize("name,want", [
    ("archive.tar.gz", ("archives", "tar.gz")), ("UPPER.JPG", ("pictures", "jpg")), (".env", ("other", None)), (".config.json", ("web_and_code", "json")),
    ("a.", ("other", None)), ("x.unknown", ("other", None)), ("movie.ts", ("web_and_code", "ts")), ("a..gz", ("archives", "gz")), ("plain", ("other", None)), ("", ("other", None)),
])
def test_classification(spark, name, want):
    c, e = classify(F.col("n"))
    assert tuple(spark.createDataFrame([(name,)], "n string").select(c, e).first()) == want
