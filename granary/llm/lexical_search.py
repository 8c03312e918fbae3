"""Ranked lexical search over all documents: an index in shards, searched by MaxScore.

Indexing reads every text once. A shard holds some thousand documents that one task read: their ids and
lengths, and for each term the documents that hold it with their counts, in the order of the shard. The
corpus statistics (documents, terms, documents that hold a term) are sums over shards. A batch of queries
asks for a bounded number of terms, so only their postings are kept unless an index of all terms is wanted.

Searching reads each shard once for all queries of a block. A query's posting lists are ordered by
what a document can gain from each at most in this shard. Lists whose bounds together stay below the score
that a document has to reach are not essential: a document that only they hold cannot qualify. Candidates come
from the essential lists; the others are probed from the largest bound down, and only for the candidates
that can still qualify. The score to reach is the k-th best so far, carried from shard to shard within
a task. Only k rows a query and task leave it; a rank over the rest gives the result.

Scores are 64-bit integers: a sum over the query's terms, repeats included, of
``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and
``m = 25 + (75 * n * N) div L``.

Defined cases: a null text or one without a term is no document (it counts in no statistic and is never
found); each of repeated rows is a document; a null doc_id ranks after others of its score; a query without terms,
or with terms that no document holds, has no rows; equal scores rank by doc_id; texts of any length are read
whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common

#: A shard is closed at so many documents or bytes of text, whichever comes first.
SHARD_DOCS = 20_000
SHARD_BYTES = 48 << 20
#: Queries that are searched in one pass, and the terms that they may hold together: what a task is sent.
BLOCK_QUERIES = 20_000
BLOCK_TERMS = 400_000

#: Term characters stay, A-Z become lower case, all else becomes a blank. Bytes from 0x80 belong to characters beyond ASCII.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text given as UTF-8."""
    return text.translate(_FOLDED).split()


_POSTINGS = "shard string, docs binary, lengths binary, n_docs long, n_terms long, terms array<binary>, starts binary, places binary, counts binary"
_POSTINGS_ARROW = pa.schema([("shard", pa.string()), ("docs", pa.binary()), ("lengths", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("starts", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1


class _Shard:
    """Postings while a shard is filled."""

    def __init__(self):
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, list[int]] = defaultdict(list)
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes, wanted: frozenset[bytes] | None) -> None:
        found = terms(text)
        if not found:
            return
        place = len(self.docs)
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(found))
        self.bytes += len(text)
        for term, count in Counter(found if wanted is None else filter(wanted.__contains__, found)).items():
            self.lists[term].append(place << 32 | count)

    def closed(self, name: str) -> pa.RecordBatch:
        known = sorted(self.lists)
        packed = np.array([x for t in known for x in self.lists[t]], np.int64)
        starts = np.cumsum([0, *(len(self.lists[t]) for t in known)])
        row = {
            "shard": name, "docs": np.array(self.docs, "<i8").tobytes(), "lengths": np.array(self.lengths, "<i4").tobytes(), "n_docs": len(self.docs), "n_terms": sum(self.lengths), "terms": known,
            "starts": starts.astype("<i4").tobytes(), "places": (packed >> 32).astype("<i4").tobytes(), "counts": (packed & 0xFFFFFFFF).astype("<i4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _POSTINGS_ARROW)


def build_index(docs: DataFrame, wanted: frozenset[bytes] | None = None, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A durable index, a row a shard. ``wanted``: the only terms to keep postings of; statistics of documents cover all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, open_shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), common.utf8(b.column(1))):
                open_shard.add(i, t, wanted)
                if len(open_shard.docs) >= shard_docs or open_shard.bytes >= shard_bytes:
                    yield open_shard.closed(f"{part}-{number}")
                    number, open_shard = number + 1, _Shard()
        if open_shard.docs:
            yield open_shard.closed(f"{part}-{number}")
        pa.default_memory_pool().release_unused()

    return common.durable(common.texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, _POSTINGS), "postings")


@dataclass
class Statistics:
    """Of the whole corpus: documents, terms with repeats, and documents that hold each term asked for."""

    n_docs: int
    n_terms: int
    holding: dict[bytes, int] = field(repr=False)

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.holding[term] + 1)))


def statistics(index: DataFrame, asked: frozenset[bytes]) -> Statistics:
    """Sums over shards. ``asked`` is bounded by a block of queries; only its terms come to the driver."""
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("t")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in batches:
            for known, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term, n in zip(known, np.diff(np.frombuffer(starts, "<i4")).tolist()):
                    if term in asked:
                        found[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    held = index.select("terms", "starts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return Statistics(total["d"], total["t"], {bytes(r["term"]): r["n"] for r in held})


def gain(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count gives to a document of length norm ``m``, before the term's weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


class Best:
    """The k best (score, doc_id) of one query."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.append(self.scores, scores), np.append(self.docs, docs)
        best = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[best], docs[best]


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray, int]], docs: np.ndarray, best: Best) -> int:
    """Adds a shard's documents that qualify to ``best``; returns how many postings were not read.

    ``lists``: for each term its largest contribution here, the places that hold it (ascending), their
    contributions, and the length of the list.
    """
    lists = sorted(lists, key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in lists])
    needed = int(np.searchsorted(bounds, best.least, "left"))  # lists before it stay below the score to reach, even together
    if needed == len(lists):
        return sum(x[3] for x in lists)
    scores = np.zeros(len(docs), np.int64)
    for _, places, given, _ in lists[needed:]:
        scores[places] += given
    found = np.flatnonzero(scores)
    own, skipped = scores[found], 0
    for k in range(needed - 1, -1, -1):
        least = best.least if len(own) < best.k else max(best.least, int(np.partition(own, len(own) - best.k)[len(own) - best.k]))
        can = own + bounds[k] >= least
        found, own = found[can], own[can]
        _, places, given, n = lists[k]
        if not len(found):
            return skipped + sum(x[3] for x in lists[: k + 1])
        at = np.searchsorted(places, found)
        at[at == n] = 0
        hit = places[at] == found
        own = own + np.where(hit, given[at], 0)
        skipped += max(0, n - len(found))
    can = own >= best.least
    best.add(own[can], docs[found[can]])
    return skipped


def search_index(index: DataFrame, queries: list[tuple[int | None, list[bytes]]], k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each query (item_id and terms); ``queries`` is one block."""
    if len(queries) > BLOCK_QUERIES:
        raise ValueError(f"at most {BLOCK_QUERIES} queries in a block")
    asked = frozenset(t for _, q in queries for t in q)
    known = statistics(index, asked)
    weight = {t: known.weight(t) for t in known.holding}
    plans = [[(t, n * weight[t]) for t, n in Counter(q).items() if weight.get(t)] for _, q in queries]
    item = [i for i, _ in queries]
    n_docs, n_terms = known.n_docs, known.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in plans]
        for b in batches:
            for r in b.to_pylist():
                docs, lengths = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["lengths"], "<i4").astype(np.int64)
                starts, places, counts = np.frombuffer(r["starts"], "<i4"), np.frombuffer(r["places"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.int64)
                m = 25 + (75 * lengths * n_docs) // n_terms
                spans = {t: (a, z) for t, a, z in zip(r["terms"], starts[:-1].tolist(), starts[1:].tolist()) if t in asked}
                gains = {t: gain(counts[a:z], m[places[a:z]]) for t, (a, z) in spans.items()}
                most = {t: int(g.max()) for t, g in gains.items()}
                for i, plan in enumerate(plans):
                    lists = [(w * most[t], places[spans[t][0] : spans[t][1]], w, t) for t, w in plan if t in spans and most[t]]
                    if sum(x[0] for x in lists) >= found[i].least:
                        max_score([(top, at, w * gains[t], len(at)) for top, at, w, t in lists], docs, found[i])
        rows = [(i, item[i], d, s) for i, best in enumerate(found) for d, s in zip(best.docs.tolist(), best.scores.tolist())]
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["query", "item_id", "doc_id", "score"])

    shards = index.select("docs", "lengths", "terms", "starts", "places", "counts")
    ranked = shards.mapInArrow(run, "query long, item_id long, doc_id long, score long").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")))
    return ranked.filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries in blocks of bounded size, as a stream over the partitions of ``items``."""
    block, asked = [], set()
    for r in items.toLocalIterator():
        own = terms((r["text"] or "").encode())
        if block and (len(block) == BLOCK_QUERIES or len(asked) + len(set(own)) > BLOCK_TERMS):
            yield block
            block, asked = [], set()
        block.append((r["item_id"], own))
        asked.update(own)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. Each block of items reads the documents once."""
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(wanted):
        index = build_index(docs, frozenset(t for _, q in block for t in q), id_col=id_col, text_col=text_col)
        found = search_index(index, block, k)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
