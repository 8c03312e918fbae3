import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm import filter_audit as A

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_masks(rows):
    """rows: (doc_id, text)."""
    out = []
    for i, text in rows:
        t = text or ""
        w = WORDS.findall(t)
        fails = [
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows),
        ]
        out.append(sum(f << k for k, f in enumerate(fails)))
    return out


def brute_audit(rows, labels):
    """rows: (doc_id, part, mask)."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out = {}
    for part in {p for _, p, _ in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [(i, m) for i, p, m in rows if p == part]
            every = list(left)
            for step, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone, left = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                shapley[letter] += len(gone)
                failing = sum(1 for _, m in every if m & bit)
                out[part, "".join(order), step + 1] = [len(left), len(gone), failing - len(gone), sum(m == bit for _, m in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"] or "") for r in docs.collect()]
    masks = brute_masks([(i, t) for i, t, _ in rows])
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted([(i, p, m) for (i, _, p), m in zip(rows, masks)], key=key)
    assert sorted([tuple(r) for r in A.failure_masks(docs).select("doc_id", "part", "mask").collect()], key=key) == want
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in A.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == brute_audit(want, labels)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, "").otherwise("x"))
    docs = docs.unionByName(docs.select(*(F.lit(None).cast("long").alias(c) if c == "doc_id" else c for c in docs.columns)))
    check(spark, docs, [(5, 1, 0), (5, 0, 1), (3, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)])
    assert A.audit_filters(no_docs.withColumn("lang", F.lit("x")), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_copies_across_borders(spark, parts):
    """One text of 400 rows, repeated rows and null ids among them, over many ranges; every fingerprint the same in the last case."""
    many = "word " * 120 + "#"
    rows = [(1000 - k // 2, many, "en") for k in range(400)] + [(None, many, "en")] * 9 + [(k, f"text {k % 17} " + "Ab cd " * k, "de") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check(spark, docs, [(k, k % 2, int(k % 3 == 0)) for k in range(0, 1000, 5)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_fingerprints_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(A.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(k, f"t{k % 5}", "en") for k in range(60)] + [(3, "t3", "en")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), [])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
