import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from granary.llm import entry
from granary.llm import quality_classifier as C
from granary.llm import quality_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= {i, i + 1, i + 2}
    marks = [c for c in text if 32 < ord(c) < 127 and not c.isalnum()]
    bare = [w for w in words if all(c in marks for c in w)]
    ends, capitals = [w for w in words if w[-1] in "#*$%&|<>"], [w for w in words if "A" <= w[0] <= "Z"]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(marks), len(bare), len(ends), len(capitals)


def test_statistics(spark, small, odd_docs):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs):
        got = sorted((str(r[0]), *r[1:]) for r in R.text_statistics(df).collect())
        assert got == sorted((str(r["doc_id"]), *brute(r["text"])) for r in df.select("doc_id", "text").collect())


def brute_path(forest, tree, x):
    node, depth = 0, 0
    while forest.column[tree][node] >= 0:
        node = 2 * node + (2 if x[forest.column[tree][node]] >= forest.value[tree][node] else 1)
        depth += 1
    return forest.path[tree][node]


def brute_features(s):
    words, chars, symbols, _, _, marks, bare, ends, capitals = s
    n, c = max(words, 1), max(chars, 1)
    return [c / n, symbols / c, marks / c, bare / n, ends / n, capitals / n]


def test_forest_decides(spark, small):
    """Scores, threshold and verdicts against a walk through the trees, and what they catch of rows not calibrated on."""
    sf = small.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules, statistics = R.fit_rules(spark, docs, labels.filter(~C.held_out("doc_id")))
    got = {r["doc_id"]: r for r in entry.op8_quality_rules(spark, sf).collect()}
    assert len(got) == docs.count() and len(rules.forest.column) == 100 and rules.forest.psi == 256
    normal = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    steps = {}
    for i, r in got.items():
        x = brute_features([r[c] for c in R.STAT_COLUMNS])
        mean = sum(brute_path(rules.forest, t, x) for t in range(100)) / 100
        steps[i] = int(2 ** (-mean / normal) * 4096)
        assert abs(r["anomaly"] * 4096 - steps[i]) <= 1e-6
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and steps[i] <= rules.threshold)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if not got[r["doc_id"]]["base_failed"]}
    known = {i: q for i, q in quality.items() if zlib.crc32(str(i).encode()) % 5}

    def told(rows, threshold):
        return sum(q == 0 and steps[i] > threshold for i, q in rows.items()), -sum(q == 1 and steps[i] > threshold for i, q in rows.items())

    allowed = [told(known, t) for t in range(4097) if -told(known, t)[1] <= 0.005 * sum(known.values())]
    assert told(known, rules.threshold) == max(allowed)
    held = {i: q for i, q in quality.items() if i not in known}
    caught, lost = told(held, rules.threshold)
    n_bad = sum(q == 0 for q in held.values())
    assert n_bad > 0 and caught >= 0.5 * n_bad and -lost <= 0.02 * sum(held.values())
    assert sum(not r["kept"] and not r["base_failed"] for r in got.values()) >= 0.02 * len(got)
    assert {r["doc_id"] for r in rules.keep(docs).select("doc_id").collect()} == {i for i, r in got.items() if r["kept"]}


def test_each_tree_has_a_sample_of_all_rows(spark):
    names = ", ".join(f"{c} long" for c in R.STAT_COLUMNS)
    rows = [(i, 100 + i % 7, 500 + i, *range(7)) for i in range(3000)] * 2  # repeated rows count once
    df = spark.createDataFrame(rows, f"doc_id long, {names}")
    rules = R.QualityRules(n_trees=6, psi=32)
    got = rules.samples(df).toPandas()
    assert (got.groupby("tree").size() == 32).all() and got.tree.nunique() == 6 and not got.duplicated(["tree", "word_chars"]).any()
    every = R.QualityRules(n_trees=6, psi=3000).samples(df).toPandas()
    for t, own in got.groupby("tree"):
        assert sorted(own.pick) == sorted(every[every.tree == t].pick)[:32]
    assert got.word_chars.nunique() > 150


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 3))
    x[:5] += 8
    trees = [R.grow_tree(x[rng.choice(2000, 256, replace=False)], 256, rng) for _ in range(100)]
    s = R.IsolationForest(*map(np.array, zip(*trees)), 256).scores(x)
    assert s[:5].min() > np.quantile(s[5:], 0.99)
    assert len(R.grow_tree(x[:0], 8, rng)[0]) == 15


def test_threshold():
    assert R.calibrated([], 0.1) is None
    assert R.calibrated([(5, 10, 0), (9, 0, 4), (7, 1, 3)], 0.0) == 7
    assert R.calibrated([(5, 10, 0), (9, 0, 4), (7, 1, 3)], 0.1) == 5
    assert R.calibrated([(5, 10, 0)], 0.5) == 5
    assert R.calibrated([(5, 0, 3), (4, 0, 1)], 0.0) == 3


def test_rules_on_odd_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (1, 1), (13, 1), (None, 1), (2, None)], "doc_id long, quality int")):
        for df in (odd_docs, no_docs):
            rules, statistics = R.fit_rules(spark, df, labels)
            assert rules.judge(statistics).count() == df.count()
            assert rules.keep(df).columns == df.columns


def test_classifier_on_held_out_rows(spark, small):
    sf = small.replace("0.001", "0.01")
    got = entry.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_classifier_on_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (13, 0), (None, 1), (7, None), (6, 1)], "doc_id long, quality int")
    model = C.QualityClassifier(bits=12).fit(odd_docs, labels)
    a, b = (sorted((str(r[0]), r[1]) for r in model.score(odd_docs).collect()) for _ in range(2))
    assert a == b and len(a) == odd_docs.count() and all(0 <= s <= 1 for _, s in a)
    assert model.keep(odd_docs, 0.3).columns == odd_docs.columns and model.score(no_docs).count() == 0
    again = C.QualityClassifier(bits=12).fit(odd_docs, labels)
    assert (again.weights == model.weights).all()
    blank = C.QualityClassifier(bits=12).fit(no_docs, labels)
    assert {r[0] for r in blank.score(odd_docs).select("score").collect()} == {0.5}


def test_held_out_rows(spark):
    df = spark.range(200).withColumn("o", C.held_out("id"))
    assert all(r["o"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in df.collect())
    assert df.filter(F.col("o")).count() > 0


def plain_vector(raw, bits):
    """Index to value of a text, gram by gram in whole numbers."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)

    def shape(w):
        ascii_alnum = bool(re.search(rb"[0-9A-Za-z\x80-\xff]", w))
        kind = 1 if re.fullmatch(rb"[0-9]+", w) else 2 if not ascii_alnum else 3 if re.search(rb"[0-9]", w) else 4 if re.match(rb"[A-Z]", w) else 5 if re.search(rb"[^0-9A-Za-z\x80-\xff]\Z", w) else 6
        return kind + 8 * min(len(w) // 4, 7)

    h = [zlib.crc32(re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), w)) for w in words]
    s = [7 if i and h[i] == h[i - 1] else shape(w) for i, w in enumerate(words)]
    grams = [1 << 50, *(x + 1 for x in h), *(x + (2 << 50) for x in s)]
    grams += [(a * 0xD6E8FEB86659FD93 % 2**64) ^ (b + (1 << 40)) for a, b in zip(h, h[1:])] + [a * 64 + b + (3 << 50) for a, b in zip(s, s[1:])]
    grams += [(a * 64 + b) * 64 + c + (4 << 50) for a, b, c in zip(s, s[1:], s[2:])] if len(s) > 2 else []
    times = Counter(((g ^ (g >> 31)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits) for g in grams)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in times.values()))
    return {i: math.log1p(n) / norm for i, n in times.items()}


def plain_training(rows, alpha, beta, l1, l2, passes):
    """Follow the regularised leader, one weight after another."""
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for vector, label in rows:
            w = {i: weight(i) for i in vector}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in vector.items())))
            for i, v in vector.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


TEXTS = ["Good words stand here, and more of them.", "buy buy BUY now!!! 100% FREE $$$", "", "   ", "a1 B2 c3 ... 77 77", "é É 漢字 naïve-word end.", "one", "The same the SAME the same", "x" * 5000 + " tail"] + [f"text {k} of the set, number {k * k}" for k in range(12)]


def test_vectors_by_brute_force():
    for bits in (8, 20):
        hasher = C.Hasher(bits)
        for t in TEXTS:
            index, value = hasher(t.encode())
            want = plain_vector(t.encode(), bits)
            assert index.tolist() == sorted(want) and np.allclose(value, [want[i] for i in sorted(want)], atol=1e-12)


def test_training_and_scores_by_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    labels = [(i, int(i % 3 != 1)) for i in range(len(TEXTS)) if i != 4]
    model = C.QualityClassifier(bits=12).fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    order = sorted(labels, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    rows = [({i: float(np.float32(v)) for i, v in plain_vector(TEXTS[d].encode(), 12).items()}, q) for d, q in order]
    want = plain_training(rows, 0.5, 1.0, 0.02, 0.5, 3)
    assert np.allclose(model.weights, [want.get(i, 0.0) for i in range(1 << 12)], atol=1e-5)
    for r in model.score(docs).collect():
        dot = sum(want.get(i, 0.0) * v for i, v in plain_vector(TEXTS[r["doc_id"]].encode(), 12).items())
        assert abs(r["score"] - 1 / (1 + math.exp(-dot))) < 1e-5
