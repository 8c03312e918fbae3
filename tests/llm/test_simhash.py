import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from granary.llm import entry
from granary.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), f"{fp:016x}", least.get(root(i))) for i, (d, fp) in enumerate(prints))


def test_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r[0], brute_print(r[1])) for r in docs])
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in entry.op7_simhash_near_dedup(spark, small).collect()) == want


def test_odd_documents(odd_docs, no_docs):
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in odd_docs.collect()])
    got = S.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got) == want
    assert S.near_duplicates(no_docs).count() == 0


def test_same_hash_as_sql(spark):
    h = spark.sql("select xxhash64('one two three') as h").first()["h"]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_every_link_has_a_key():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = fp.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    (ka, oa), (kb, ob) = S.candidate_keys(fp), S.candidate_keys(other)
    a, b = {}, {}
    for keys, owner, into in ((ka, oa, a), (kb, ob, b)):
        for k, o in zip(keys.tolist(), owner.tolist()):
            into.setdefault(o, set()).add(k)
    assert all(a[i] & b[i] for i in range(len(fp)))


def test_links_span_random_clusters(spark):
    rng = np.random.default_rng(4)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for x in list(fps)[:10]:
        for _ in range(60):
            y = x
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                y ^= 1 << int(b)
            fps.add(y)
    prints = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in prints]
    ids = {s[0]: i for i, s in enumerate(signed)}
    roots = S.components(S.links(spark.createDataFrame(signed, "fp long").repartition(3)))
    groups = {}
    for r in roots.collect():
        groups.setdefault(r["root"], set()).add(ids[r["node"]])
    want = {}
    for d, _, c in brute_components(prints):
        want.setdefault(c, set()).add(int(d))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_links_of_a_key_with_many_fingerprints_in_any_order():
    """Over 1024 fingerprints: links whose larger side comes first must be found, too."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([base, rng.integers(0, 1 << 63, 1500, dtype=np.uint64)])
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))])
    fps = np.concatenate([fps, *(base[0] ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.arange(i).astype(np.uint64)) for i in range(1, 64))])
    fps = rng.permutation(np.unique(fps))
    assert len(fps) > 4 * 1024
    found, want = S._Forest(), S._Forest()
    for a, b in S._links(fps, fps, S._Forest(), 3):
        assert a < b and (a ^ b).bit_count() <= 3 and found.join(a, b)  # a forest: no link tells what is known
    for at, x in enumerate(fps):
        for y in fps[at + 1 :][np.bitwise_count(fps[at + 1 :] ^ x) <= 3].tolist():
            want.join(int(x), y)
    assert [found.root(x) for x in fps.tolist()] == [want.root(x) for x in fps.tolist()]


def test_large_key_is_compared_in_cells(spark):
    """50,000 fingerprints of one key: no cell holds more than two parts, and every link is found."""
    rng = np.random.default_rng(8)
    low = rng.choice(1 << 32, 50_000, replace=False).astype(np.uint64)
    low[1::2] = low[::2] ^ (np.uint64(1) << rng.integers(0, 32, 25_000).astype(np.uint64))
    fps = np.unique(low)
    df = spark.createDataFrame([(x,) for x in fps.tolist()], "fp long")
    cells = S.in_cells(df.withColumn("key", F.lit(1)), "key", "fp", 4096).groupBy("lo", "hi").count().collect()
    assert len(cells) == 13 * 14 // 2 and max(r["count"] for r in cells) < 2.2 * 4096
    found = S._Forest()
    for a, b in map(tuple, S.links(df).collect()):
        assert (a ^ b).bit_count() <= 3
        found.join(a, b)
    assert all(found.root(a) == found.root(b) for a, b in zip(low[::2].tolist(), low[1::2].tolist()))


def jaccard(a, b):
    a, b = (set(S.shingle_hashes(x.encode(), 5).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(60, int(rng.integers(0, 60)), replace=False).astype(np.uint64)) for _ in range(60)] + [np.arange(50, dtype=np.uint64)] * 2
    like = lambda x, y: 1.0 if not len(x) and not len(y) else len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    i, j = S.similar_pairs(sets, None, 0.6, columns=7)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for b in range(62) for a in range(b) if like(sets[a], sets[b]) >= 0.6}
    i, j = S.similar_pairs(sets[:30], sets[30:], 0.6, columns=7)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(30) for b in range(32) if like(sets[a], sets[30 + b]) >= 0.6}


def planted(rng, n):
    """Texts, and copies of them with some words changed, so that similarities lie on both sides of 0.8."""
    words = [f"{a}{b}" for a in "ka lo mi tu re san dor vel".split() for b in "na po qui ster lun far gom ble".split()]
    out = []
    for _ in range(n):
        text = rng.choice(words, int(rng.integers(80, 400))).tolist()
        out.append(" ".join(text))
        for _ in range(int(rng.integers(0, 4))):
            own = list(text)
            for at in rng.integers(0, len(own), int(rng.uniform(0, 0.06) * len(own))):
                own[at] = f"x{rng.integers(1000)}"
            out.append(" ".join(own))
    return out


def test_near_copies_against_brute_force(spark):
    """Every link is a pair of similarity 0.8 or more, and nearly all such pairs are found (the recall that the README gives)."""
    texts = planted(np.random.default_rng(10), 250)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [np.unique(S.shingle_hashes(x.encode(), 5)) for x in texts]
    want = set(zip(*(x.tolist() for x in S.similar_pairs(sets, None, 0.8))))
    assert len(want) > 100 and all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in list(want)[:50])
    up = S._Forest()
    for a, b in want:
        up.join(a, b)
    for block in (1000, 3):
        got = {r["doc_id"]: r["component_id"] for r in S.NearCopies(block=block).components(df).collect()}
        assert len(got) == len(texts) and all(up.root(i) == up.root(c) for i, c in got.items())  # nothing joined that is not alike
        assert sum(got[a] == got[b] for a, b in want) >= 0.9 * len(want)


def test_one_row_of_each_component_stays(spark, odd_docs, no_docs):
    found = S.NearCopies().components(odd_docs)
    rows = odd_docs.collect()
    assert found.count() == len(rows)
    kept = S.keep_first(odd_docs, found)
    assert kept.columns == odd_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    texts = {r["text"] or "" for r in rows}
    assert len(got) == len(set(got)) and {t or "" for _, t in got} <= texts
    assert {t for _, t in got if t and t.split()} >= {"a", "one two three", "another text", "no id"} and sum(not (t or "").split() for _, t in got) == 1
    assert S.keep_first(no_docs, S.NearCopies().components(no_docs)).count() == 0
    # repeated rows, rows without id, and a doc_id that repeats with another text
    same = [(1, "p q r s t u v")] * 3 + [(None, "lone text here")] * 3 + [(None, "p q r s t u v")] + [(2, "first of two"), (2, "p q r s t u v"), (9, "p q r s t u v")]
    df = spark.createDataFrame([(i, t, "x") for i, t in same], "doc_id long, text string, `a.b` string")
    kept = S.keep_first(df, S.NearCopies().components(df))
    assert kept.columns == df.columns
    assert sorted(((r[0] or 0), r[1]) for r in kept.collect()) == [(0, "lone text here"), (1, "p q r s t u v"), (2, "first of two")]


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(1))
    got = S.components(edges.unionByName(spark.createDataFrame([(900, 901), (901, 900), (7, 7)], "a long, b long")))
    by = {r["node"]: r["root"] for r in got.collect()}
    assert all(by[i] == 0 for i in range(n + 1)) and by[901] == by[900] == 900


def test_rounds_of_components_are_short(spark):
    """Repeated edges, both ways round, cost nothing, and a round has few stages: each is tasks that the driver keeps account of."""
    chain = spark.range(-450, 450).selectExpr("id as a", "id + 1 as b").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "rounds")
    try:
        got = S.components(chain.unionByName(chain).unionByName(chain.selectExpr("b as a", "a as b"))).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["node"], r["root"]) for r in got) == [(x, -450) for x in range(-450, 451)]
    status = sc.statusTracker()
    assert sum(len(status.getJobInfo(j).stageIds) for j in status.getJobIdsForGroup("rounds")) < 140


def test_prefixes_of_alike_sets_share_a_shingle():
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 5, 1 << 6)
    alike = 0
    for _ in range(3000):
        a = rng.integers(0, 1 << 63, int(rng.integers(1, 40)), dtype=np.uint64) << np.uint64(1)
        keep = rng.random(len(a)) >= 0.12
        b = np.concatenate([a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared):
            alike += 1
            assert len(np.intersect1d(S.prefix(a, counts, 0.8), S.prefix(b, counts, 0.8)))
    assert alike > 500
    assert S.prefix(np.zeros(0, np.uint64), counts, 0.8).tolist() == [0]
    assert len(S.prefix(np.arange(10, dtype=np.uint64), counts, 0.8)) == 3


def drifting(rng, n):
    """Texts of which each differs from the one before by one word: alike to some before it, ever less to the first."""
    words = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        words[int(rng.integers(len(words)))] = f"d{i}"
        out.append(" ".join(words))
    return out


def linked(spark, texts, **settings):
    """The components that NearCopies finds if all texts are one loose group, as sets of places."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sigs = {r["sig"]: r["doc_id"] for r in S._signed(df).collect()}
    assert len(sigs) == len(texts)
    members = S.durable(S._signed(df).select("doc_id", "sig", F.lit(5).cast("long").alias("group")), "members")
    up = S._Forest()
    for a, b in map(tuple, S.NearCopies(**settings)._links(df, members).collect()):
        up.join(sigs[a], sigs[b])
    return up


def test_large_loose_group_is_compared_exactly(spark):
    """One group, cut by prefixes, leaders and cells, whatever their sizes: the links of brute force, no more and no fewer."""
    rng = np.random.default_rng(12)
    texts = list(dict.fromkeys(planted(rng, 40) + drifting(rng, 60) + ["", " ", "\n", "one", "two words", "One", "x y z x y z"]))
    sets = [np.unique(S.shingle_hashes(x.encode(), 5)) for x in texts]
    want = S._Forest()
    for i, j in zip(*(x.tolist() for x in S.similar_pairs(sets, None, 0.8))):
        want.join(i, j)
    n_groups = len({want.root(i) for i in range(len(texts))})
    assert 5 < n_groups < len(texts) - 20
    for settings in ({}, {"block": 3}, {"block": 25, "places": 1 << 4}, {"block_bytes": 20_000}):
        got = linked(spark, texts, **settings)
        assert [got.root(i) for i in range(len(texts))] == [want.root(i) for i in range(len(texts))]


def test_loose_group_of_20000_texts(spark):
    """Unlike texts in one loose group leave it by their prefixes; 3,000 near copies of one text meet its leader, not each other."""
    rng = np.random.default_rng(13)
    first = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(3000):
        own = list(first)
        own[int(rng.integers(5, 95))] = f"own{i}"
        texts.append(" ".join(own))
    for i in range(8500):
        text = [f"u{x}" for x in rng.integers(0, 5000, 30)] + [f"k{i}"]
        texts += [" ".join(text), " ".join([*text, "end"])]
    got = linked(spark, texts)
    assert len({got.root(i) for i in range(3000)}) == 1
    assert all(got.root(i) == i and got.root(i + 1) == i for i in range(3000, 20_000, 2))


def test_very_long_texts(spark):
    """Texts of a megabyte: cells are dealt by bytes, too."""
    rng = np.random.default_rng(14)
    texts = []
    for f in range(3):
        words = [f"f{f}w{x}" for x in rng.integers(0, 99_999, 110_000)]
        for c in range(3):
            words[1000 * c] = f"edit{c}"
            texts.append(" ".join(words))
    assert min(map(len, texts)) > 900_000
    got = linked(spark, texts, block_bytes=1 << 20)
    assert [got.root(i) for i in range(9)] == [0, 0, 0, 3, 3, 3, 6, 6, 6]
