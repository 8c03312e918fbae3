import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import topk

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, k):
    """Every row against every other row, in exact integers."""
    d = max((len(v) for _, v in rows if v), default=0)
    ok = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [min(max(math.floor(1024 * np.float32(c).astype(float)), LEAST), MOST) for c in v]
            ok.append((i, x + [0] * (d - len(x))))
    out = []
    for at, (q, a) in enumerate(ok):
        if q is not None and q % 5 == 0:
            s = sorted((-min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST), i is None, i or 0) for to, (i, b) in enumerate(ok) if to != at)[:k]
            out += [(q, r + 1, None if no else i, -p) for r, (p, no, i) in enumerate(s)]
    return sorted(out, key=str)


def search(spark, rows, shape):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("uid", F.lit(2))
    return sorted(map(tuple, shape.search(topk.integer_vectors(df), F.col("vec_id") % 5 == 0).collect()), key=str)


SHAPES = [topk.TopK(k=10, block_rows=50, query_rows=16, column_blocks=2, levels=6, head=4), topk.TopK(k=7), topk.TopK(k=1000, block_rows=64, levels=3)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + (i % 7 == 0), 12)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(120)]  # one vector many times: ties go to the smaller id
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 12), (603, [float("inf")] * 12), (605, [1.0, -2.0]), (None, [1.0] * 12), (None, None), (610, [])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (10, [0.5] * 12), (33, rows[33][1]), (33, [2.5] * 12)]  # rows of their own, though their vec_id repeats
    for shape in SHAPES:
        assert search(spark, rows, shape) == brute(rows, shape.k)


@pytest.mark.parametrize("spread", ["wide", "norms", "equal", "huge"])
def test_any_magnitude(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (260, 16))
    if spread == "wide":
        x *= rng.uniform(40, 1e6, (260, 1))
    elif spread == "norms":
        x *= 10.0 ** rng.uniform(-2, 3, (260, 1))
    elif spread == "equal":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x[::9] *= 1e30
        x[1::10] *= 1e12
        x = np.clip(x, -1e37, 1e37)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    for shape in SHAPES[:2]:
        assert search(spark, rows, shape) == brute(rows, shape.k)


def test_norms_end_a_search_early():
    """With spread norms, blocks of short vectors cost nothing."""
    rng = np.random.default_rng(3)
    q, near = rng.integers(-900, 900, (5, 8)), rng.integers(-9000, 9000, (600, 8))
    s = topk.Search(np.arange(5), q, np.full(5, LEAST), np.eye(8), 3, 4)
    s.visit(np.arange(10, 610), np.arange(10, 610), near)
    low, seen = s.low.copy(), []
    s._take = lambda *a: seen.append(a)
    s.visit(np.arange(1000, 1600), np.arange(1000, 1600), near // 1000)
    assert not seen and (s.low == low).all() and (low > LEAST).all()


def test_no_group_holds_all_queries(spark):
    df = spark.range(900).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    shape = topk.TopK(query_rows=64)
    groups = shape._grouped(topk.integer_vectors(df).withColumns({"depth": F.lit(1), "low": F.lit(0).cast("long")}), {1: 900})
    sizes = [r[0] for r in groups.select(F.size("uids")).collect()]
    assert sum(sizes) == 900 and len(sizes) == 15 and max(sizes) < 130


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert topk.top_products(df, F.lit(True)).count() == 0
    assert topk.top_products(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    blank = spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_products(blank, F.lit(True)).collect())) == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert topk.top_products(blank, F.lit(False)).count() == 0
