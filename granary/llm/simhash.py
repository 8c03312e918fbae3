"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: texts are lower-cased (A-Z), split at ASCII white space into words, and every run of three
words (fewer words: the whole sequence), repeats included, is hashed by XXH64 (UTF-8, seed 42). Bit i of
the 64-bit fingerprint is one if it is set in over half of the hashes. A text without words has
fingerprint zero. Two fingerprints link at ``max_bits`` = 3 or fewer differing bits.

Candidates: the fingerprint is cut into four 16-bit segments. Three differing bits leave at least one
segment untouched, and among the other three at least one with at most one differing bit (else each
would hold two). That segment, padded to 23 bits, is decoded by the perfect binary Golay code: words at
distance one share the index of a codeword nearby, where a word at distance three from its own
codeword also takes the five codewords at distance four. So fingerprints that link share a key
(exact segment, other segment's codeword), for one of 12 ordered pairs of segments. ``near_pairs`` takes
codewords of both segments of a pair: then five differing bits always leave a shared key, and more often do.

Work: exact copies collapse first (fingerprints are grouped, with partial sums), so keys, joins and
components are over distinct fingerprints. Keys are dealt out by hash; a key with over ``block``
fingerprints is dealt by pairs of parts, so that no cell compares more than about ``block`` with ``block``.
Each task verifies the distance and emits only a forest of the links it finds (a link that joins what is
joined already in this task tells nothing new), so no task emits all pairs of a group. Components then
come from rounds of star contraction over that forest, each round a shuffle whose result is written to
the shared folder. Rows whose fingerprint neither repeats nor links find nothing in the last join.

:class:`NearCopies` is the setting for a corpus: texts are copies if their sets of five-word shingles have
a Jaccard similarity of 0.8 or more. Fingerprints of two-word shingles (an edit changes fewer of them) bring
candidates together by ``near_pairs``, within ``max_bits`` = 10; whatever is connected that way is one loose
group, and no link is made without comparing shingle sets in full. With more texts, ever more unrelated ones
are within ten bits, so loose groups are made finer before they are compared; no step loses a pair of theirs:

* A group beyond ``block`` texts or ``block_bytes`` of sets is cut by *prefixes*: shingles are put into one order
  (rarest first, by a histogram of fixed size, then by hash); two sets that are alike share one of the first
  fifth of theirs. Only texts connected by such shingles stay together; this moves ids, never sets.
* In a group that is still as large, every set meets its *leader* (one text, copied to each part of the group).
  Those like the leader are linked. Distance (one less the similarity) is a metric, so of them only those
  can be like one that is not which are as far from the leader as the others are near; only these go on.
* What is left is compared in cells of at most two parts, dealt by number and by bytes of sets.

Defined cases: null and empty texts have fingerprint zero and link with each other; texts of any length
are read whole; repeated rows are repeated in the result; a row without doc_id belongs to its component
like any other, and is its first only if all are without; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, discard, durable, texts, utf8
from granary.llm.suffix_dedup import among

SEGMENTS, SEGMENT_BITS = 4, 16
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of words of a text's UTF-8 bytes, repeats included."""
    words = raw.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text's UTF-8 bytes."""
    hashes = shingle_hashes(raw, shingle, seed)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and sig (a hash of the exact text) of every row; no shuffle."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(x, shingle) for x in utf8(b.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "sig"])

        return run

    return arrow_map(_signed(texts(docs, id_col=id_col, text_col=text_col)), make, "doc_id long, fp long, sig long")


def _signed(base: DataFrame) -> DataFrame:
    return base.withColumn("sig", F.xxhash64(F.coalesce("text", F.lit(""))))


def _codewords() -> np.ndarray:
    data = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros_like(data)
    for i in range(12):
        words ^= np.where(data >> i & 1, GOLAY << i, 0)
    return words


def _weight(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word (padded to 23): up to six codeword indices, and how many of them count."""
    words = _codewords()
    segment = np.arange(1 << SEGMENT_BITS, dtype=np.int64)
    # decode by syndrome: each of the 2048 remainders belongs to one error pattern of at most three bits
    errors = np.array([0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)], np.int64)

    def remainder(x):
        x = x.copy()
        for i in range(22, 10, -1):
            x ^= np.where(x >> i & 1, GOLAY << (i - 11), 0)
        return x

    leader = np.zeros(1 << 11, np.int64)
    leader[remainder(errors)] = errors
    index = np.full(1 << 23, -1, np.int16)
    index[words] = np.arange(len(words))
    error = leader[remainder(segment)]
    centre = segment ^ error
    keys = np.zeros((len(segment), 6), np.int16)
    keys[:, 0] = index[centre]
    count = np.ones(len(segment), np.int8)
    far = np.nonzero(_weight(error) == 3)[0]
    heptads = words[_weight(words) == 7]  # codewords at distance four from a weight-three error: those that hold it
    for h in heptads:
        held = far[(error[far] & h) == error[far]]
        keys[held, count[held]] = index[centre[held] ^ h]
        count[held] += 1
    return keys, count


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def candidate_keys(fp: np.ndarray, near_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of distinct fingerprints (uint64), and the position of the fingerprint each belongs to."""
    if not _tables:
        _tables.append(golay_keys())
    keys, count = _tables[0]
    parts = [(fp >> np.uint64(SEGMENT_BITS * i)).astype(np.int64) & 0xFFFF for i in range(SEGMENTS)]
    out, owner = [], []
    for first in range(SEGMENTS):
        for near in range(SEGMENTS):
            if near == first or near_pairs and near < first:
                continue
            for j in range(6 if near_pairs else 1):
                head = (first * SEGMENTS + near) << 28 | (keys[parts[first], j].astype(np.int64) if near_pairs else parts[first]) << 12
                for k in range(6):
                    has = np.nonzero((count[parts[near]] > k) & ((count[parts[first]] > j) | (not near_pairs)))[0]
                    out.append(head[has] | keys[parts[near][has], k].astype(np.int64))
                    owner.append(has)
    return np.concatenate(out), np.concatenate(owner)


class _Forest:
    """Union-find over the fingerprints of a task; the smaller fingerprint is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(left: np.ndarray, right: np.ndarray, forest: _Forest, max_bits: int, step: int = 1024):
    """Verified links between two sets of fingerprints (or within one), in any order, that join something new.

    Of a pair of blocks with many links, each fingerprint offers one link to another component at a time, so
    the components with links left at least halve in each round.
    """
    within = left is right
    for at in range(0, len(left), step):
        for to in range(at if within else 0, len(right), step):
            a, b = left[at : at + step], right[to : to + step]
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits)
            apart = i < j if within and to == at else a[i] != b[j]
            i, j = i[apart], j[apart]
            while len(i):
                few = len(i) <= step
                some = np.arange(len(i)) if few else np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
                for x, y in zip(a[i[some]].tolist(), b[j[some]].tolist()):
                    if forest.join(x, y):
                        yield min(x, y), max(x, y)
                if few:
                    break
                of_a, of_b = (np.array([forest.root(x) for x in side.tolist()], np.uint64) for side in (a, b))
                apart = of_a[i] != of_b[j]
                i, j = i[apart], j[apart]


def _large(rows: DataFrame, by: str, block: int, size: str | None, most: int) -> tuple[DataFrame, int]:
    """A durable table (large, parts) of the values of ``by`` with over ``block`` rows or ``most`` of ``size``, and how many there are."""
    n = F.count(F.lit(1)) / block
    share = n if size is None else F.greatest(n, F.sum(size) / most)
    sizes = rows.groupBy(by).agg(share.alias("share"), F.count(F.lit(1)).alias("n_rows")).filter("share > 1 and n_rows > 1")
    large = durable(sizes.select(F.col(by).alias("large"), F.ceil("share").cast("int").alias("parts")), "large-groups")
    return large, large.count()


def _with_parts(rows: DataFrame, by: str, item: str, large: tuple[DataFrame, int], how: str = "left") -> DataFrame:
    """rows with parts (1, if ``by`` is not large) and own, the part that the hash of ``item`` deals the row to."""
    table, n = large
    small = F.broadcast(table) if n <= 100_000 else table
    cut = rows.join(small, rows[by] == table["large"], how).drop("large").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut.withColumn("own", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))


def in_cells(rows: DataFrame, by: str, item: str, block: int, *, size: str | None = None, most: int = 1) -> DataFrame:
    """rows with columns lo, hi and own, dealt out by (by, lo, hi) and sorted so.

    A value of ``by`` that over ``block`` rows have (or over ``most`` of the column ``size``) is cut into parts by the hash of
    ``item``; a row goes to the cells of its part (own) with every part, so that every two rows meet, and none holds more
    than two parts. Others are one cell.
    """
    large = _large(rows, by, block, size, most)
    if large[1] == 0:
        cells = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
    else:
        cut = _with_parts(rows, by, item, large)
        cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*rows.columns, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    return cells.repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi")


def _cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, int, dict[str, list]]]:
    """The cells of a task one after another: lo, hi and the named columns, each a list of arrays. The first three columns are by, lo, hi."""
    cell, held = None, {n: [] for n in names}
    for b in batches:
        key = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        if not len(key):
            continue
        starts = np.append(0, np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1)
        ends = np.append(starts[1:], len(key))
        several = ends - starts > 1
        several[[0, -1]] = True  # they may go on in other batches; within one, a row alone in its cell meets none
        for start, end in zip(starts[several].tolist(), ends[several].tolist()):
            own = tuple(key[start].tolist())
            if own != cell:
                if cell is not None:
                    yield cell[1], cell[2], held
                cell, held = own, {n: [] for n in names}
            for n in names:
                held[n].append(b.column(b.schema.get_field_index(n)).slice(start, end - start))
    if cell is not None:
        yield cell[1], cell[2], held


def _pairs(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int]] = []

    def batch():
        x = np.array(rows, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    for pair in found:
        rows.append(pair)
        if len(rows) == 10_000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def links(distinct: DataFrame, max_bits: int = 3, *, near_pairs: bool = False, block: int = 4096) -> DataFrame:
    """distinct: a table with one column fp, each once. a, b (a < b unsigned): links that span all links."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = b.column(0).to_numpy().view(np.uint64)
            keys, owner = candidate_keys(fp, near_pairs)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[owner].view(np.int64))], ["key", "fp"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def found():
            for lo, hi, held in _cells(batches, ["own", "fp"]):
                fp = np.concatenate([x.to_numpy() for x in held["fp"]]).view(np.uint64)
                if len(fp) < 2:
                    continue
                if lo == hi:
                    yield from _links(fp, fp, forest, max_bits)
                else:
                    left = np.concatenate([x.to_numpy() for x in held["own"]]) == lo
                    yield from _links(fp[left], fp[~left], forest, max_bits)

        yield from _pairs(found())

    keyed = arrow_map(distinct.select("fp"), make, "key long, fp long")
    return in_cells(keyed, "key", "fp", block).select("key", "lo", "hi", "own", "fp").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, *, name: str = "component") -> DataFrame:
    """Connected components of a table (a, b): node and root, for every node that has an edge.

    Rounds of star contraction: each node is linked to the smallest node it knows of, larger neighbours
    first, then smaller ones. Edges shrink to stars in O(log^2 n) rounds; a round is two shuffles, as a node's
    rows come sorted, the smallest neighbour first, and its result is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        rows = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        neighbours = Window.partitionBy("a").orderBy("b")
        met = rows.withColumns({"m": F.least("a", F.first("b").over(neighbours)), "k": F.row_number().over(neighbours)})
        if large:
            out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # the first row links the node itself, the others its further neighbours; repeated rows go here
            out = met.select(F.when(F.col("k") == 1, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        return out.filter(F.col("a") != F.col("b"))

    now = durable(star(edges.select("a", "b").filter(F.col("a") != F.col("b")), False), name)
    before = None
    while True:
        last, now = now, durable(star(star(now, True), False), name)
        discard(last)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, *, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every row."""
    prints = durable(fingerprints(docs, id_col=id_col, text_col=text_col).drop("sig"), "fingerprints")
    first = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(first, max_bits))
    # the smallest document of each component; only fingerprints that have a link are here
    rooted = roots.join(first.select(F.col("fp").alias("node"), "first"), "node")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = durable(rooted.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "component-of-fingerprint")
    # rows whose fingerprint neither repeats nor links are components of their own
    of_fp = first.filter("n > 1").select("fp", "first").join(linked, "fp", "full").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of_fp, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_pairs(sets: list[np.ndarray], others: list[np.ndarray] | None, similarity: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs (of one list, or of one from each) whose Jaccard similarity reaches the bound; two empty sets are alike.

    Overlaps are products of incidence matrices, taken a few columns at a time.
    """
    both = sets if others is None else [*sets, *others]
    size = np.array([len(x) for x in both], np.int64)
    owner = np.repeat(np.arange(len(both)), size)
    _, code, times = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], np.unique(code[by], return_inverse=True)[1]
    split = len(sets) if others is not None else 0
    overlap = np.zeros((len(sets), len(both) - split), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        some = slice(*np.searchsorted(code, [at, at + columns]))
        held = np.zeros((len(both), columns), np.float32)
        held[owner[some], code[some] - at] = 1
        overlap += held[: len(sets)] @ held[split:].T
    union = size[: len(sets), None] + size[None, split:] - overlap
    i, j = np.nonzero(_alike(overlap, union, similarity))
    if others is None:
        i, j = i[i < j], j[i < j]
    return i, j


def _alike(overlap: np.ndarray | int, union: np.ndarray | int, similarity: float):
    return overlap >= similarity * union - 1e-6


def prefix(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set (sorted, each once) that any set with this Jaccard similarity shares one of.

    counts: a histogram over the leading bits of shingles, of 2^n places. Of alike sets at least ``similarity`` of the
    larger is shared, so leaving out one shingle less than that leaves one of the shared. Shingles come by count, then
    by value: the order must be one for all sets, but any will do. An empty set has the shingle 0, to be alike to others.
    """
    if not len(shingles):
        return np.zeros(1, np.uint64)
    take = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1
    return shingles[np.lexsort((shingles, counts[_place(shingles, len(counts))]))[:take]]


def _place(shingles: np.ndarray, places: int) -> np.ndarray:
    return (shingles >> np.uint64(65 - places.bit_length())).astype(np.int64)


@dataclass
class NearCopies:
    """Texts whose shingle sets are alike; see the module's head."""

    shingle: int = 5
    similarity: float = 0.8
    probe: int = 2
    max_bits: int = 10
    block: int = 1000
    block_bytes: int = 32 << 20
    places: int = 1 << 18

    def components(self, docs: DataFrame) -> DataFrame:
        """doc_id, sig (hash of the exact text), component_id (its smallest doc_id) and first (whether the row is the one that stands for it) of every row."""
        prints = durable(fingerprints(docs, shingle=self.probe), "copy-fingerprints")
        exact = durable(prints.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp")), "exact-copies")
        # fingerprints are small and their keys many: a number given keeps them from being coalesced into few tasks
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        loose = components(links(exact.select("fp").repartition(tasks, "fp").distinct(), self.max_bits, near_pairs=True), name="loose")
        grouped = exact.join(loose.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("group", F.coalesce("root", "fp")).drop("root")
        several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
        members = durable(grouped.join(several, "group", "left_semi"), "loose-groups")
        rooted = durable(components(self._links(docs, members), name="copies"), "roots")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("least")
        of = exact.join(rooted.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        chosen = of.groupBy("root").agg(least, F.count(F.lit(1)).alias("n"))
        # texts that stand for themselves alone need no row here
        other = of.join(chosen.filter("n > 1"), "root").select("sig", F.col("least.doc_id").alias("least_id"), F.col("least.sig").alias("least_sig"))
        repeated = prints.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("own")).filter("n > 1").select("sig", "own")
        told = durable(repeated.join(other, "sig", "full").select("sig", F.coalesce("least_sig", "sig").alias("least_sig"), F.when(F.col("least_sig").isNull(), F.col("own")).otherwise(F.col("least_id")).alias("least_id"), F.lit(True).alias("told")), "first-of-copies")
        own = prints.select("doc_id", "sig").join(told, "sig", "left")
        is_first = F.col("told").isNull() | ((F.col("sig") == F.col("least_sig")) & F.col("doc_id").eqNullSafe(F.col("least_id")))
        return own.select("doc_id", "sig", F.when(F.col("told"), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"), is_first.alias("first"))

    def _links(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """a, b: hashes of texts that are alike, of those of one loose group; links that span all links."""
        sets = durable(self._sets(docs, members), "shingle-sets")
        large, n = found = _large(sets, "group", self.block, "size", self.block_bytes)
        if not n:
            return self._compared(sets.withColumn("core", F.lit(False)))
        # both joins are with few groups or few columns; large groups are read from the one table, not copied
        in_large = _with_parts(sets, "group", "sig", found, "inner").drop("parts", "own")
        rest = sets.join(F.broadcast(large) if n <= 100_000 else large, sets["group"] == large["large"], "left_anti")
        finer = in_large.drop("group").join(self._finer(in_large), "sig").select(*sets.columns)
        still = _large(finer, "group", self.block, "size", self.block_bytes)
        if not still[1]:
            return self._compared(rest.unionByName(finer).withColumn("core", F.lit(False)))
        met = durable(self._met_leader(finer, still), "met-leaders")
        # the most like its leader of those that are not linked to it: None, if all are
        nearest = met.groupBy("group").agg(F.max(F.when(~F.col("near"), F.col("like"))).alias("nearest"))
        needed = met.join(nearest.filter(F.col("nearest").isNotNull()), "group").filter(~F.col("near") | (F.col("like") <= F.col("nearest") + (1 - self.similarity) + 1e-6))
        needed = needed.select("group", "sig", F.col("near").alias("core"))
        small = finer.join(F.broadcast(still[0]) if still[1] <= 100_000 else still[0], finer["group"] == still[0]["large"], "left_anti")
        left = rest.unionByName(small).withColumn("core", F.lit(False)).unionByName(finer.join(needed, ["group", "sig"]))
        to_leader = met.filter(F.col("near") & (F.col("sig") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("sig").alias("b"))
        return self._compared(left).unionByName(to_leader)

    def _sets(self, docs: DataFrame, members: DataFrame) -> DataFrame:
        """group, sig, set (sorted shingle hashes) and size (its bytes and some for the row) of every member, each once."""
        shingle = self.shingle

        def make():
            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                sets = [np.unique(shingle_hashes(x, shingle)).tobytes() for x in utf8(b.column(2))]
                size = pa.array([len(x) + 64 for x in sets], pa.int64())
                return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary()), size], ["group", "sig", "set", "size"])

            return run

        # texts that no group holds stay where they are; of the copies of one only those with its smallest doc_id come here
        base = among(_signed(texts(docs)).withColumnRenamed("sig", "text_hash"), members.select("doc_id", F.col("sig").alias("text_hash")))
        by = {"id0": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull()}
        one = base.withColumns(by).groupBy("text_hash", "id0", "no_id").agg(F.first("text").alias("text"))
        wanted = members.withColumns(by).select("group", F.col("sig").alias("text_hash"), "id0", "no_id")
        joined = one.join(wanted, ["text_hash", "id0", "no_id"]).select("group", F.col("text_hash").alias("sig"), "text")
        return arrow_map(joined, make, "group long, sig long, set binary, size long")

    def _finer(self, sets: DataFrame) -> DataFrame:
        """sig and group: what shingles of prefixes connect within each group; texts that share none with another have no row."""
        similarity, places = self.similarity, self.places

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(places, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                seen = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(0)])
                total += np.bincount(_place(seen, places), minlength=places)
            held = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["place", "n"])

        sums = sets.select("set").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most `places` rows
        counts = np.zeros(places, np.int64)
        counts[sums.column("place").to_numpy()] = sums.column("n").to_numpy()

        def make():
            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                firsts = [prefix(np.frombuffer(x.as_buffer(), np.uint64), counts, similarity) for x in b.column(2)]
                at = np.repeat(np.arange(b.num_rows), [len(x) for x in firsts])
                shingle = np.concatenate(firsts).view(np.int64)
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(shingle)], ["group", "sig", "shingle"])

            return run

        keys = arrow_map(sets.select("group", "sig", "set"), make, "group long, sig long, shingle long")
        keys = durable(keys.select("sig", F.xxhash64("group", "shingle").alias("key")), "prefixes")
        least = keys.groupBy("key").agg(F.min("sig").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        edges = keys.join(least, "key").filter(F.col("sig") != F.col("least")).select(F.col("least").alias("a"), F.col("sig").alias("b"))
        return components(edges, name="finer").select(F.col("node").alias("sig"), F.col("root").alias("group"))

    def _met_leader(self, sets: DataFrame, large: tuple[DataFrame, int]) -> DataFrame:
        """group, sig, leader, like (similarity to it) and near (whether they are alike) of every row of a large group."""
        similarity = self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leader, own = None, 0
            for b in batches:
                rows = []
                for group, sig, leads, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    one = np.frombuffer(x.as_buffer(), np.uint64)
                    if leads:
                        leader, own = one, sig
                        continue
                    overlap = len(np.intersect1d(leader, one, assume_unique=True))
                    union = len(leader) + len(one) - overlap
                    rows.append((group, sig, own, overlap / union if union else 1.0, bool(_alike(overlap, union, similarity))))
                columns = list(zip(*rows)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["group", "sig", "leader", "like", "near"])

        rows = _with_parts(sets, "group", "sig", large, "inner").select("group", "parts", "own", "sig", F.lit(False).alias("leads"), "set")
        chosen = rows.groupBy("group").agg(F.min("sig").alias("sig"))
        leaders = rows.join(chosen, ["group", "sig"]).withColumns({"own": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "leads": F.lit(True)})
        dealt = rows.unionByName(leaders).repartition("group", "own").sortWithinPartitions("group", "own", F.col("leads").desc())
        return dealt.select("group", "sig", "leads", "set").mapInArrow(compare, "group long, sig long, leader long, like double, near boolean")

    def _compared(self, sets: DataFrame) -> DataFrame:
        """a, b: links within groups, each pair compared in full, but for two of the core, which have one already."""
        similarity = self.similarity

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = _Forest()

            def found():
                for lo, hi, held in _cells(batches, ["own", "sig", "core", "set"]):
                    sig = np.concatenate([x.to_numpy() for x in held["sig"]]).view(np.uint64)
                    core = np.concatenate([x.to_numpy(zero_copy_only=False) for x in held["core"]])
                    sets = [np.frombuffer(x, np.uint64) for part in held["set"] for x in part.to_pylist()]
                    left = np.concatenate([x.to_numpy() for x in held["own"]]) == lo
                    rows = np.nonzero(left)[0] if lo != hi else np.arange(len(sig))
                    columns = np.nonzero(~left)[0] if lo != hi else rows
                    i, j = similar_pairs([sets[x] for x in rows], None if lo == hi else [sets[x] for x in columns], similarity)
                    i, j = rows[i], columns[j]
                    new = ~(core[i] & core[j])
                    for x, y in zip(sig[i[new]].tolist(), sig[j[new]].tolist()):
                        if forest.join(x, y):
                            yield min(x, y), max(x, y)

            yield from _pairs(found())

        cells = in_cells(sets, "group", "sig", self.block, size="size", most=self.block_bytes)
        return cells.select("group", "lo", "hi", "own", "sig", "core", "set").mapInArrow(compare, "a long, b long")


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the first. found: of :meth:`NearCopies.components`, over docs.

    Of rows equal in doc_id and text, and so of the first's, one stays. Only rows that repeat or stand behind another
    are dealt out; all others stay where they are.
    """
    judged = found.groupBy("doc_id", "sig").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("n")).filter(~F.col("first") | (F.col("n") > 1))
    told = durable(judged.select("doc_id", F.col("sig").alias("text_hash"), "first"), "told-copies")
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they do not clash
    own = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = own.withColumns({"doc_id": doc_id.cast("long"), "text_hash": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    marked = among(own, told.select("doc_id", "text_hash"), mark="asked")
    by = {"id0": F.coalesce("doc_id", F.lit(0).cast("long")), "no_id": F.col("doc_id").isNull()}
    keys = ["id0", "no_id", "text_hash"]
    asked = marked.filter("asked").withColumns(by).join(told.withColumns(by).select(*keys, "first"), keys, "left")
    several = asked.filter(F.coalesce("first", F.lit(True))).groupBy(*keys).agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    return marked.filter(~F.col("asked")).select(*names).unionByName(several).toDF(*docs.columns)
