import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Every document scored for every item: rows (item_id, rank, doc_id, score)."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(1, "One two THREE"), (2, None), (3, ""), (4, "nowhere"), (5, "the same words the same"), (6, "é 漢字 word"), (None, "word a"), (1, "another text")]


def test_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(S.search(odd_docs, items, 3)) == brute(docs, ITEMS, 3)
    assert S.search(no_docs, items).count() == 0 and S.search(odd_docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_shards_and_ties(spark, seed, monkeypatch):
    """Frequent and rare terms, many equal scores, small shards, blocks of two queries."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(rng.randrange(2000), " ".join(rng.choices(words, k=rng.choice([1, 3, 3, 8, 60])))) for _ in range(700)] + [(7, "w1 w2 w1")] * 30
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 25])))) for k in range(9)]
    d, i = frames(spark, docs, items)
    want = brute(docs, items, 10)
    index = S.build_index(d, shard_docs=50)
    assert index.count() >= 15 and found(S.search_index(index, [(k, S.terms(t.encode())) for k, t in items])) == want
    monkeypatch.setattr(S, "BLOCK_QUERIES", 2)
    assert found(S.search(d, i)) == want
    monkeypatch.setattr(S, "BLOCK_TERMS", 3)
    assert found(S.search(d, i)) == want


def test_postings_that_cannot_matter_are_not_read():
    """A rare term fills the result; the long list of a frequent one is probed for the few candidates only."""
    rng = np.random.default_rng(1)
    frequent, rare = np.arange(5000), np.sort(rng.choice(5000, 40, replace=False))
    lists = [(5, frequent, np.full(5000, 5), 5000), (900, rare, rng.integers(500, 900, 40), 40)]
    best, docs = S.Best(10), np.arange(5000)
    assert S.max_score(lists, docs, best) == 0  # nothing to reach yet: both lists are essential
    first = best.scores.copy()
    skipped = S.max_score(lists, docs + 5000, best)
    assert skipped >= 4900 and best.scores[0] == first[0] and best.scores.tolist() == sorted(np.repeat(first, 2).tolist(), reverse=True)[:10]


def test_scores_that_tie_with_the_least_are_kept():
    best = S.Best(2)
    for docs in ([8, 9], [3, 4], [1, 2]):
        S.max_score([(10, np.array([0, 1]), np.array([10, 10]), 2)], np.array(docs), best)
    assert best.docs.tolist() == [1, 2]
