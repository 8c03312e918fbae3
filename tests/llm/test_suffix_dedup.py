import hashlib
import pathlib
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(raw)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(raw), sum(mark), runs, hashlib.sha256(bytes(c for c, m in zip(raw, mark) if not m)).hexdigest())
    return out


def digests(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.dedup_digests(df).collect()}


@pytest.fixture(scope="module")
def hard_rows():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([150, 400]))) for _ in range(6)]
    rows = [(0, "a" * 250), (1, "ab" * 200), (2, None), (3, ""), (4, "x" * 99), (5, "a" * 100), (None, base[0])]
    for i in range(6, 70):
        t = ""
        for _ in range(rnd.randint(1, 4)):
            b = rnd.choice(base)
            a = rnd.randint(0, 60)
            t += b[a : rnd.randint(a + 80, len(b))] + rnd.choice(["", "q", "é", "zz" * rnd.randint(0, 40)])
        rows.append((i, t))
    rows.append((90, "".join(rnd.choice("pqrstuv ") for _ in range(3 * S.STRETCH)) + base[1]))  # longer than a stretch
    return rows


def test_against_brute_force(spark, hard_rows, monkeypatch):
    df = spark.createDataFrame(hard_rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "wanted": F.lit(1), "at": F.lit(2)}).repartition(5)
    want = brute(hard_rows)
    assert digests(df) == want
    twice = df.unionByName(df.filter("doc_id < 9 or doc_id > 60"))
    assert digests(twice) == want and S.dedup_digests(twice).count() == twice.count()
    monkeypatch.setattr(S, "TOGETHER", 50)  # texts read together are few
    assert digests(df) == want
    monkeypatch.setattr(S, "MOST_CONTEXTS", 2)  # anchors with very many contexts
    assert digests(df) == want
    assert digests(twice) == want


def test_nothing_goes_but_by_suffix_arrays(spark, hard_rows, monkeypatch):
    df = spark.createDataFrame(hard_rows, "doc_id long, text string")
    monkeypatch.setattr(S, "suffix_array", lambda s: S.np.argsort(s, kind="stable").tolist())  # not sorted beyond the first symbol
    monkeypatch.setattr(S, "earlier_matches", lambda sa, lcp, rank: [0] * len(sa))
    monkeypatch.setattr(S, "common_prefixes", lambda s, sa: [0] * len(s))
    empty = S._verdicts(spark.createDataFrame([], S._CONTEXT))
    assert empty.count() == 0
    rows = [(7, 1, 0, b"x" * 100, 1, 1, 0, True, False), (8, 1, 0, b"y" * 100, 1, 1, 0, True, False), (8, 2, 1, b"z" + b"y" * 100, 1, 1, 9, False, False)]
    x = [S.np.array(c) for c in zip(*rows)]
    assert S.judged_contexts(x[0], x[1], x[2], [r[3] for r in rows], x[4], x[5], x[6], x[7]).num_rows == 0
    monkeypatch.undo()
    assert S.judged_contexts(x[0], x[1], x[2], [r[3] for r in rows], x[4], x[5], x[6], x[7]).num_rows == 3
    monkeypatch.setattr(S, "_verdicts", lambda contexts: empty)
    assert S.judged(df).count() == 0


def on_disk(spark, began):
    """Bytes of shuffle files that queries begun since then have left; files are deleted in the background."""
    for wait in (0, 0.2, 0.5, 1, 3, 0):
        time.sleep(wait)
        dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
        found = [p.stat() for d in dirs for p in pathlib.Path(d).rglob("shuffle_*.data")]
        left = sum(x.st_size for x in found if x.st_mtime >= began)
        if not left:
            break
    return left


def test_a_step_leaves_nothing_but_its_table(spark, hard_rows, monkeypatch):
    df = spark.createDataFrame(hard_rows, "doc_id long, text string").repartition(3)
    left, tables, began = [], [], time.time()

    def durable(df, name):
        out = plain(df, name)
        tables.append(pathlib.Path(out.durable_path.removeprefix("file://")))
        left.append((name, on_disk(spark, began)))
        return out

    plain = S.durable
    monkeypatch.setattr(S, "durable", durable)
    judged = S.judged(df)
    assert [n for n, _ in left if n != "documents-with-repeats"] == ["occurrences", "verdicts", "spans", "judged"]
    # the counts between the steps deal out a few numbers
    assert max(n for _, n in left) < 20_000
    assert [n for t, (n, _) in zip(tables, left) if t.exists() and n != "documents-with-repeats"] == ["judged"] and judged.count() > 0


def test_an_only_context_needs_no_bytes(spark):
    """Passages that occur with the same surroundings only: no text moves for their contexts, and they go all the same."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    rows = [(i, passage) for i in range(5)] + [(9, passage[:100])]
    held = [S.pa.RecordBatch.from_arrays([S.pa.array([r[0] for r in rows[:5]]), S.pa.array([passage] * 5), S.pa.array([7] * 5)], ["doc_id", "text", "text_hash"])]
    found = S.pa.Table.from_batches(S._occurrences(b for b in S._anchor_rows(iter(held)))).to_pylist()
    firsts = [x for x in found if not x["later"]]
    assert len(firsts) > 5 and all(x["lone"] and x["copies"] and x["right"] == min(100, 700 - x["at"]) for x in firsts)
    x = {c: S.np.array([r[c] for r in firsts]) for c in ("h", "ctx", "doc_id", "text_hash", "at", "copies", "right")}
    left = S.np.minimum(x["at"], S.LEFT)
    full = [passage.encode()[a - n : a + S.WINDOW] for a, n in zip(x["at"].tolist(), left.tolist())]
    args = x["doc_id"], x["text_hash"], x["at"], x["copies"]
    want = S.judged_contexts(x["h"], x["ctx"], left, full, *args)
    assert want.num_rows and S.judged_contexts(x["h"], x["ctx"], left, [None] * len(full), *args, x["right"]).equals(want)
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_anchor_with_very_many_contexts(spark):
    """A shared ending after 25,000 different beginnings: dense anchors, in one task's stream and as windows."""
    rnd = random.Random(6)
    tail = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rnd.choice("pqrstuvw") for _ in range(90)) + tail) for i in range(25_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.dedup_digests(df).collect()
    want = {i: (240, 0 if i == 0 else None) for i, _ in rows}
    seen = {}
    for i, t in rows:  # the longest run before the shared ending that an earlier text shares with it
        k = 0
        while t[90 - k - 1 : 90] in seen:
            k += 1
        for m in range(1, 30):
            seen.setdefault(t[90 - m : 90], i)
        want[i] = 0 if i == 0 else 150 + k
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_small_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert digests(df) == want
    kept = S.dedup_texts(df)
    assert kept.schema == df.schema
    for r in kept.collect():
        raw = r["text"].encode()
        assert r["n_chars"] == len(r["text"]) and (want[r["doc_id"]][3] == hashlib.sha256(raw).hexdigest() or want[r["doc_id"]][1] > 0)


def test_odd_documents(odd_docs, no_docs):
    assert S.dedup_digests(odd_docs).count() == odd_docs.count() and S.dedup_texts(odd_docs).count() == odd_docs.count()
    assert S.dedup_digests(no_docs).count() == 0 and S.dedup_texts(no_docs).columns == no_docs.columns


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.randoms(use_true_random=False))
def test_suffix_array(s, rnd):
    s = [*s, 0]
    sa = S.suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    rank = [rnd.randint(0, 5) for _ in s]

    def shared(i, j):
        k = 0
        while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        return k

    assert S.earlier_matches(sa, S.common_prefixes(s, sa), rank) == [max([0, *(shared(i, j) for j in range(len(s)) if rank[j] < rank[i])]) for i in range(len(s))]
