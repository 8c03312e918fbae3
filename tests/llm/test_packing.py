import bisect
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import packing

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def pieces_of(text, capacity=2048):
    ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    first = len(ids) % capacity if len(ids) > capacity and len(ids) % capacity else min(len(ids), capacity)
    cuts = [0, *range(first, len(ids), capacity), len(ids)]
    return [(k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]


def check(docs, got, capacity=2048):
    want = sorted((str(r["doc_id"]), *p) for r in docs.collect() for p in pieces_of(r["text"], capacity))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in got) // capacity)


def plain_best_fit(lengths, capacity):
    """How many bins best fit decreasing needs, piece by piece."""
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        used += room == capacity
        bisect.insort(rooms, room - n)
    return used


def hard(n, capacity, seed):
    """Lengths that n full bins of three pieces can hold."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(capacity // 5, capacity // 2))
        b = int(rng.integers(capacity // 5, min(capacity // 2, capacity - a - capacity // 5) + 1))
        out += [a, b, capacity - a - b]
    return out


def test_never_worse_than_best_fit(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = packing.pack_documents(docs, PATH).collect()
    used, least = check(docs, got)
    assert least <= used <= plain_best_fit([r["length"] for r in got], 2048)


def test_odd_documents(odd_docs, no_docs):
    for capacity in (16, 2):
        check(odd_docs, packing.pack_documents(odd_docs, PATH, packer=packing.IslandPacker(capacity=capacity)).collect(), capacity)
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("doc_id", [7, None])
def test_many_rows_of_one_id(spark, doc_id):
    docs = spark.range(100_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(0), F.col("id") % 23)).alias("text"))
    got = packing.pack_documents(docs, PATH).toPandas()
    assert len(got) == 100_000
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (got.offset == ends - got.length).all() and ends.max() <= 2048
    assert got.sequence_id.nunique() <= plain_best_fit(got.length.tolist(), 2048)


@pytest.mark.parametrize(("n", "capacity"), [(60, 100), (200, 200), (1000, 2048)])
def test_search_beats_best_fit(spark, n, capacity):
    for seed in (1, 2):
        lengths = hard(n, capacity, seed)
        start = packing.best_fit_decreasing(Counter(lengths), capacity)
        assert -start.fitness()[0] == plain_best_fit(lengths, capacity) and start.pieces() == Counter(lengths)
        counts = spark.createDataFrame([(x, 1) for x in lengths], "length long, n long")
        found = packing.IslandPacker(capacity=capacity).search(counts)
        assert found.pieces() == Counter(lengths) and max(map(found.fill, found.bins)) <= capacity
        assert n <= -found.fitness()[0] < -start.fitness()[0]


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(5)
    lengths = Counter(rng.integers(1, 100, 600).tolist())
    a, b = packing.evolve(lengths, 100, [], rng, 4, 0)[:2]
    for _ in range(20):
        child = a.crossed(b, lengths, rng).mutated(rng)
        assert child.pieces() == lengths and max(map(child.fill, child.bins)) <= 100
        assert packing.Packing.unpacked(child.packed(), 100).bins == child.bins


def test_size_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(6)
    lengths = Counter(np.clip(rng.lognormal(5, 1, 100_000).astype(int), 1, 2048).tolist())
    for times in (1, 1000):
        found = packing.evolve({n: t * times for n, t in lengths.items()}, 2048, [], np.random.default_rng(1), 4, 20)
        assert all(len(p.bins) < 8 * 2048 for p in found)


def test_places_are_gapless():
    lengths = Counter(hard(50, 64, 3))
    p = packing.evolve(lengths, 64, [], np.random.default_rng(2), 4, 20)[0]
    rows = [(n, k) for n, t in lengths.items() for k in range(t)]
    sequence, offset = packing.Places(p)(*np.array(rows, np.int64).T)
    held = {}
    for (n, _), s, o in zip(rows, sequence.tolist(), offset.tolist()):
        held.setdefault(s, []).append((o, n))
    assert sorted(held) == list(range(-p.fitness()[0]))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64


def test_plain_words_leave_nothing_to_regular_expressions():
    marked = pa.array([" ".join(f"word{i}" for i in range(40)).replace(*packing._BLANK)])
    assert not any(pc.match_substring_regex(marked, pattern)[0].as_py() for pattern, _ in packing._CUTS)


def test_cuts_at_any_white_space():
    rng = np.random.default_rng(8)
    parts = [" ", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "\x85", "\r", "a", "Z", ".", ",", "é", "漢", "1", "'s", "!", "<|endoftext|>", "\x01", "🙂"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(5000)]
    ids, ends = packing.TokenCounter(PATH).ids(pa.array(texts))
    want = [e.ids for e in PLAIN.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [x for e in want for x in e] and ends.tolist() == np.cumsum([len(e) for e in want]).tolist()
