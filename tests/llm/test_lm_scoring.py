import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import lm_scoring as L


def brute(rows, targets, mass=50.0):
    """The same models with exact words and pairs, each document scored without its own counts."""
    texts = {i: (t or "").encode().lower().split() for i, t in rows}
    words = {w for t in texts.values() for w in t}

    def model(ids):
        one, two = Counter(), Counter()
        for i in ids:
            if texts[i]:
                one.update([None, *texts[i]])
                two.update(zip([None, *texts[i]], texts[i]))
        return one, two, sum(one.values()) - one[None]

    t, b = model(targets), model(texts)
    scale = sum(t[0].values()) / sum(b[0].values())

    def loss(m, i, f, without):
        (one, two, n), text, (own1, own2, own_n) = m, texts[i], model([i] if without else [])
        out = 0.0
        for v, w in zip([None, *text], text):
            pw = (f * (one[w] - own1[w]) + 1) / (f * (n - own_n) + len(words) + 1)
            out -= math.log((f * (two[v, w] - own2[v, w]) + mass * pw) / (f * (one[v] - own1[v]) + mass))
        return out / len(text)

    return {i: loss(t, i, 1.0, i in targets) - loss(b, i, scale, True) if x else 0.0 for i, x in texts.items()}


def test_against_brute_force(spark, small):
    """The registered settings, whole texts, and probabilities of one history that sum to one."""
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 40")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    targets = [i for i, _ in rows if i % 3 == 0]
    want = brute(rows, set(targets))
    got = L.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in targets + targets[:3]], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["score"] == pytest.approx(r["loss_target"] - r["loss_background"])


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["loss_background"] for r in L.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in range(100, 150)], "doc_id long")).collect()}
    twice = [got[i] for i in got if i < 20 or i >= 1000]
    assert max(twice) < min(got[i] for i in range(20, 200))


@pytest.mark.parametrize(("tokens", "docs", "size"), [(1500, 1000, 1 << 12), (50_000, 7, 1 << 16), (1 << 20, 50_000, 16 << 20)])
def test_every_word_and_pair_counts(spark, tokens, docs, size, monkeypatch):
    """70,000 words and some 200,000 pairs in few and in many blocks and buckets: each has its own count."""
    for name, value in (("BLOCK_TOKENS", tokens), ("BLOCK_DOCS", docs), ("BUCKET_BYTES", size)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(70_000 * rng.random() ** (1 + i % 3))}" for _ in range(1000))) for i in range(300)] + [(1000, None), (1001, "once")]
    targets = [i for i, _ in rows if i % 3 == 0]
    want = brute(rows, set(targets))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = L.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in targets], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_packed_keys(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.zeros(0, np.uint64))
    counts = [rng.integers(0, 1 << 40, len(keys)) for _ in range(2)]
    got = L._unpacked(L._packed(keys, *counts), 2)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, [keys, *counts]))


def test_a_bucket_answers_in_the_order_of_the_keys(tmp_path):
    """And a block that is written twice, by a task that runs again, is one file."""
    table = pa.table([pa.array([1]), pa.array(["a b a"]), pa.array([True])], ["doc_id", "text", "target"])
    L._write_block(f"file://{tmp_path}/x", table)
    L._write_block(f"file://{tmp_path}/x", table)
    assert [p.name for p in tmp_path.iterdir()] == ["x"]
    block = L._Block([L._Words()(b"a b a")], np.array([1]))
    asked = [(0, 5, 1, *(L._packed(*c) for c in block.counts()))]
    told = L._answer(pa.Table.from_pydict({n: [r[k] for r in asked] for k, n in enumerate(["bucket", "block", "crc", "words", "pairs"])}))
    n, t = np.frombuffer(L._expand(told.column("pairs")[0].as_py()), "<i8").reshape(2, -1)
    assert len(n) == 3 and n.tolist() == t.tolist() == [1, 1, 1] and told.column("distinct")[0].as_py() == 2 and told.column("n_all")[0].as_py() == 4


def test_odd_documents(spark, odd_docs, no_docs):
    for targets in (spark.createDataFrame([(4,), (None,)], "doc_id long"), spark.createDataFrame([], "doc_id long")):
        for df in (odd_docs, no_docs):
            got = L.cross_entropy_difference(df, targets).collect()
            assert len(got) == df.count() and all(math.isfinite(r["score"]) for r in got)


def test_targets_beyond_the_bound_are_joined(spark, odd_docs, monkeypatch):
    targets = spark.createDataFrame([(4,), (5,)], "doc_id long")
    want = sorted(map(str, L._marked(odd_docs.select("doc_id", "text"), targets).select("doc_id", "target").collect()))
    monkeypatch.setattr(L, "BloomCascade", lambda cascade=L.BloomCascade: cascade(max_total=0))
    got = sorted(map(str, L._marked(odd_docs.select("doc_id", "text"), targets).select("doc_id", "target").collect()))
    assert got == want
