"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become token ids with an end mark; only those longer than a sequence are cut (the first piece
may be shorter). Packing sees a piece's length only, and pieces of equal length are alike, so the whole
corpus is one bin-packing problem over counted lengths: at most ``capacity`` of them, however many
pieces there are. No block is packed by itself, so nothing is lost at block borders.

An individual is a packing: bin contents (lengths and their numbers) and how many bins have each.
Crossover takes whole well-filled bins of one parent into the other, drops the other's bins that would
repeat their pieces, and puts the pieces so displaced back by best fit. Mutation empties a few badly
filled bins and some others and does the same in a shaken order. Fitness is the number of bins, then
the sum of squared fills. Each island evolves a population in a task; after an epoch its best individuals
migrate to the next island of the ring (a shuffle of a few rows). Every island starts from plain best fit
decreasing over all pieces, so the result is never worse than that.

Work: tokenising is one pass, written to the shared folder (a few numbers a piece, no ids). Each piece has
a number among its task's pieces of its length; counts by task and length give its number among all, and
that its bin and place, by a look-up in the winner (bounded by the number of lengths, and broadcast). An
individual holds at most four more contents a length than those it was made of, and never more than there
are bins; on millions of pieces some thousands were seen.

Defined cases: a null text is empty and has the end mark alone; texts of any length are cut; repeated
rows (equal or no doc_id) are separate pieces, each placed, however many there are; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import durable, texts

#: Chunks of text whose ids a task remembers. A memo only: it changes no result.
MEMO_ENTRIES = 400_000
#: Chunks encoded as one text: more are slower, since what the tokeniser keeps for a text outgrows a processor's cache.
JOINED = 32
#: Places where the pre-tokeniser always ends a token, whatever stands around: before a blank that follows
#: something visible; around a single line end between visible characters; between a letter and a full
#: stop or comma. \x01 marks them; a text that holds it is not cut. Blanks are many: all are marked, and
#: the marks that follow other white space, which are few, are taken back.
_MARK = "\x01"
_BLANK = (" ", "\x01 ")
_CUTS = (
    (r"([\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\x01", "\\1"),
    (r"([!-~])\n([!-~])", "\\1\x01\n\x01\\2"),
    (r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,])", "\\1\x01\\2"),
)
#: A chunk without white space but for one blank before it.
_PLAIN = r"^ ?[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of stretches of ``values``."""
    to = np.cumsum(lengths)
    return values[np.repeat(starts - (to - lengths), lengths) + np.arange(to[-1] if len(to) else 0)]


class TokenCounter:
    """Token ids by a ``tokenizers`` file.

    Texts are cut where the pre-tokeniser always ends a token, equal chunks of a batch are encoded once,
    and the ids gathered back.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_MARK, *special])
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {}

    def _encoded(self, chunks: pa.Array) -> list[bytes]:
        """The ids of each chunk: those not remembered are encoded many to a text, a line end between any two."""
        memo, known = self.memo, chunks.to_pylist()
        out = list(map(memo.get, known))
        new = [k for k, x in enumerate(out) if x is None]
        plain = pc.match_substring_regex(chunks.take(pa.array(new, pa.int64())), _PLAIN).to_pylist() if new else []
        alone, joined = [k for k, p in zip(new, plain) if not p], [k for k, p in zip(new, plain) if p]
        groups = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        for at in range(0, len(groups), 128):
            some, ids, fit = groups[at : at + 128], [], []
            for group, e in zip(some, self.tokenizer.encode_batch_fast(["\n".join([known[k] for k in g]) for g in some], add_special_tokens=False)):
                own = e.ids
                if own.count(self.line_end) == len(group) - 1:
                    fit += group
                    ids += own
                    ids.append(self.line_end)
                else:
                    alone += group
            found = np.array(ids, "<u4")
            cuts, raw = (4 * np.flatnonzero(found == self.line_end)).tolist(), found.tobytes()
            for k, a, z in zip(fit, [-4, *cuts], cuts):
                out[k] = raw[a + 4 : z]
        for at in range(0, len(alone), 4096):
            part = alone[at : at + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([known[k] for k in part], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<u4").tobytes()
        room = max(0, MEMO_ENTRIES - len(memo))
        memo.update((known[k], out[k]) for k in new[:room])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False).astype(bool)
        cut = pc.replace_substring(texts.filter(pa.array(~whole)), *_BLANK)
        for pattern, marked in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern, marked)
        words = pc.split_pattern(cut, _MARK)
        flat = words.flatten().dictionary_encode()
        code, ids = flat.indices.to_numpy(), self._encoded(flat.dictionary)
        length = np.array([len(x) // 4 for x in ids], np.int64)
        values = np.frombuffer(b"".join(ids), "<u4")
        pieces = _ragged(values, (np.cumsum(length) - length)[code], length[code])
        ends = np.zeros(n, np.int64)
        per_word = np.append(0, np.cumsum(length[code]))
        ends[~whole] = np.diff(per_word[words.offsets.to_numpy() - words.offsets[0].as_py()])
        if not whole.any():
            return pieces, np.cumsum(ends)
        alone = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        ends[whole] = list(map(len, alone))
        out, to = [], np.append(0, np.cumsum(ends[~whole]))
        rest, cut = iter(alone), iter(zip(to[:-1].tolist(), to[1:].tolist()))
        for w in whole.tolist():
            if w:
                out.append(next(rest))
            else:
                a, z = next(cut)
                out.append(pieces[a:z])
        return np.concatenate(out), np.cumsum(ends)


_counters: dict[str, TokenCounter] = {}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; one pass, no shuffle.

    task and number: which of its task's pieces of this length it is, from 0. They hold for a table that is written at once.
    """
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = TokenCounter(tokenizer_path)
        counter = _counters[tokenizer_path]
        end = np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        try:
            for b in batches:
                for at in range(0, b.num_rows, 5000):
                    part = b.slice(at, 5000)
                    ids, ends = counter.ids(pc.fill_null(part.column(1), ""))
                    raw = memoryview(ids.tobytes())
                    rows, begin = [], 0
                    for doc_id, to in zip(part.column(0).to_pylist(), ends.tolist()):
                        n = to - begin + 1
                        cuts = [*range(n % capacity if n > capacity and n % capacity else min(n, capacity), n, capacity), n]
                        start = 0
                        for k, z in enumerate(cuts):
                            crc = zlib.crc32(raw[4 * (begin + start) : 4 * (begin + min(z, n - 1))])
                            rows.append((doc_id, k, start, z - start, zlib.crc32(end, crc) if z == n else crc, task, seen[z - start]))
                            seen[z - start] += 1
                            start = z
                        begin = to
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], names)
        finally:  # the worker goes on to other tasks
            counter.memo.clear()
            pa.default_memory_pool().release_unused()

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, _PIECES)


class Packing:
    """One individual: how often each bin content occurs. A content is a tuple of (length, pieces), as pieces of equal length are alike."""

    __slots__ = ("bins", "capacity")

    def __init__(self, capacity: int, bins: dict[tuple, int] | None = None):
        self.capacity, self.bins = capacity, dict(bins or {})

    @staticmethod
    def fill(content: tuple) -> int:
        return sum(n * t for n, t in content)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins are better, then a higher sum of squared fills."""
        return -sum(self.bins.values()), sum(t * self.fill(c) ** 2 for c, t in self.bins.items())

    def pieces(self) -> Counter:
        out: Counter = Counter()
        for content, times in self.bins.items():
            for n, t in content:
                out[n] += t * times
        return out

    def best_fit(self, pieces: dict[int, int], order: list[int]) -> None:
        """Each piece, in the order of lengths given, goes into the fullest bin that still has room.

        Equal bins are treated at once: a length adds at most four contents, however many pieces it has.
        """
        by_room: dict[int, dict[tuple, int]] = {}
        for content, times in self.bins.items():
            by_room.setdefault(self.capacity - self.fill(content), {})[content] = times
        rooms = sorted(by_room)

        def put(content, room, times):
            if room not in by_room:
                by_room[room] = {}
                bisect.insort(rooms, room)
            by_room[room][content] = by_room[room].get(content, 0) + times

        for n in order:
            left = pieces.get(n, 0)
            while left:
                at = bisect.bisect_left(rooms, n)
                if at < len(rooms):
                    room = rooms[at]
                    content, times = by_room[room].popitem()
                    if not by_room[room]:
                        del by_room[room], rooms[at]
                else:
                    room, content = self.capacity, ()
                    times = -(-left // (room // n))
                each = room // n  # a bin that took one is the fullest for the next, too
                whole = min(times, left // each)
                part = left - whole * each if whole < times else 0
                if whole:
                    put((*content, (n, each)), room - each * n, whole)
                if part:
                    put((*content, (n, part)), room - part * n, 1)
                if content and times > whole + bool(part):
                    put(content, room, times - whole - bool(part))
                left -= whole * each + part
        self.bins = {}
        for contents in by_room.values():
            for content, times in contents.items():
                c = Counter()
                for n, t in content:
                    c[n] += t
                content = tuple(sorted(c.items(), reverse=True))
                self.bins[content] = self.bins.get(content, 0) + times

    def crossed(self, other: Packing, pieces: dict[int, int], rng: np.random.Generator) -> Packing:
        """Inject whole well-filled bins of ``other``; drop own bins that repeat their pieces; best-fit the displaced."""
        contents = list(other.bins)
        fill = np.array([self.fill(c) for c in contents], float)
        share = 0.5 * (fill / self.capacity) ** 16
        times = rng.binomial(np.array([other.bins[c] for c in contents]), share)
        child = Packing(self.capacity, {c: t for c, t in zip(contents, times.tolist()) if t})
        left = Counter(pieces)
        left.subtract(child.pieces())
        for content in sorted(self.bins, key=lambda c: (-self.fill(c), c)):
            t = min(self.bins[content], *(left[n] // k for n, k in content))
            if t:
                child.bins[content] = child.bins.get(content, 0) + t
                for n, k in content:
                    left[n] -= t * k
        child.best_fit(left, sorted((n for n, t in left.items() if t), reverse=True))
        return child

    def mutated(self, rng: np.random.Generator) -> Packing:
        """Empty the worst bins and some others, and best-fit their pieces in a shaken order."""
        contents = sorted(self.bins, key=lambda c: (self.fill(c), c))
        times = np.array([self.bins[c] for c in contents])
        worst = max(2, int(times.sum()) // 20)
        gone = np.clip(worst - (np.cumsum(times) - times), 0, times)
        gone += rng.binomial(times - gone, 0.05)
        child = Packing(self.capacity, {c: t for c, t in zip(contents, (times - gone).tolist()) if t})
        displaced = Packing(self.capacity, {c: t for c, t in zip(contents, gone.tolist()) if t}).pieces()
        child.best_fit(displaced, shaken(displaced, rng, 0.1))
        return child

    def packed(self) -> bytes:
        """Contents as 64-bit integers: times, number of lengths, then each length and its pieces."""
        out = []
        for content, times in self.bins.items():
            out += [times, len(content), *(x for pair in content for x in pair)]
        return np.array(out, "<i8").tobytes()

    @staticmethod
    def unpacked(raw: bytes, capacity: int) -> Packing:
        x, at, bins = np.frombuffer(raw, "<i8").tolist(), 0, {}
        while at < len(x):
            times, n = x[at : at + 2]
            bins[tuple(zip(x[at + 2 : at + 2 + 2 * n : 2], x[at + 3 : at + 2 + 2 * n : 2]))] = times
            at += 2 + 2 * n
        return Packing(capacity, bins)


def shaken(pieces: dict[int, int], rng: np.random.Generator, by: float) -> list[int]:
    """Lengths, longest first but for some noise."""
    lengths = np.array(sorted(pieces), float)
    return lengths[np.argsort(-lengths * (1 + by * rng.standard_normal(len(lengths))), kind="stable")].astype(int).tolist()


def best_fit_decreasing(pieces: dict[int, int], capacity: int) -> Packing:
    p = Packing(capacity)
    p.best_fit(pieces, sorted(pieces, reverse=True))
    return p


def evolve(pieces: dict[int, int], capacity: int, seeds: list[bytes], rng: np.random.Generator, population: int, generations: int) -> list[Packing]:
    """A population evolved from given individuals, the rest new; best first. None is worse than plain best fit if it starts from nothing."""
    if not pieces:
        return [Packing(capacity)]
    own = [Packing.unpacked(s, capacity) for s in seeds] or [best_fit_decreasing(pieces, capacity)]
    while len(own) < population:
        p = Packing(capacity)
        p.best_fit(pieces, shaken(pieces, rng, 0.02 * 4 ** rng.integers(0, 4)))
        own.append(p)
    scored = sorted(((p.fitness(), k, p) for k, p in enumerate(own)), key=lambda x: (x[0], -x[1]), reverse=True)
    for k in range(generations):
        a, b = (int(i) for i in rng.choice(len(scored), 2, replace=False))
        child = scored[min(a, b)][2].crossed(scored[max(a, b)][2], pieces, rng) if rng.random() < 0.7 else scored[0][2].mutated(rng)
        fitness = child.fitness()
        if fitness > scored[-1][0] and all(fitness != f for f, _, _ in scored):
            scored[-1] = (fitness, population + k, child)
            scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for _, _, p in scored]


class Places:
    """Where each piece goes in a packing: the pieces of a length, numbered from 0, fill its places in order."""

    def __init__(self, packing: Packing):
        rows, taken, sequence = [], Counter(), 0
        for content, times in sorted(packing.bins.items(), reverse=True):
            at = 0
            for n, k in content:
                rows.append((n << 48 | taken[n], k, sequence, at, n))
                taken[n] += k * times
                at += n * k
            sequence += times
        self.key, self.each, self.sequence, self.at, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and numbers."""
        key = length << 48 | number
        i = np.searchsorted(self.key, key, side="right") - 1
        within = key - self.key[i]
        return self.sequence[i] + within // self.each[i], self.at[i] + within % self.each[i] * length


@dataclass
class IslandPacker:
    """Parameters of the search; :meth:`pack` runs it."""

    capacity: int = 2048
    islands: int = 4
    population: int = 6
    generations: int = 16
    epochs: int = 3
    elites: int = 2
    seed: int = 11

    def pack(self, pieces: DataFrame) -> DataFrame:
        """pieces: a durable table from :func:`cut_pieces`. Their columns with sequence_id and offset."""
        counts = durable(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
        places = pieces.sparkSession.sparkContext.broadcast(Places(self.search(counts)))
        w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
        before = counts.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
        fields = ["doc_id", "piece", "start", "length", "ids_crc32"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = places.value(b.column(3).to_numpy(), b.column(5).to_numpy())
                    yield pa.RecordBatch.from_arrays([*b.columns[:5], *map(pa.array, found)], [*fields, "sequence_id", "offset"])

        numbered = pieces.join(before, ["task", "length"]).select(*fields, (F.col("number") + F.col("before")).alias("number"))
        return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

    def search(self, counts: DataFrame) -> Packing:
        """The best packing found of pieces counted by length (rows of a length add up)."""
        lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))  # at most ``capacity`` rows
        problem = lengths.agg(F.array_sort(F.collect_list(F.struct("length", "n"))).alias("lengths"))
        state = problem.select(F.explode(F.sequence(F.lit(0), F.lit(self.islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("elites"))
        for epoch in range(self.epochs):
            state = durable(self._epoch(state.repartition(self.islands, "island"), epoch), f"epoch-{epoch}")
            if epoch < self.epochs - 1:  # migration: the best of each island go to the next of its ring, too
                gone = state.select(((F.col("island") + 1) % self.islands).alias("island"), F.lit(None).cast(state.schema["lengths"].dataType).alias("lengths"), "elites")
                met = state.select("island", "lengths", "elites").unionByName(gone)
                state = met.groupBy("island").agg(F.first("lengths", ignorenulls=True).alias("lengths"), F.flatten(F.collect_list("elites")).alias("elites"))
        best = state.agg(F.max_by(F.col("elites")[0], F.struct("fitness", (-F.col("island")).alias("island"))).alias("best")).first()["best"]
        return Packing.unpacked(best or b"", self.capacity)

    def _epoch(self, state: DataFrame, epoch: int) -> DataFrame:
        capacity, population, generations, elites, seed = self.capacity, self.population, self.generations, self.elites, self.seed
        pairs = pa.list_(pa.struct([("length", pa.int64()), ("n", pa.int64())]))
        kind = pa.schema([("island", pa.int32()), ("lengths", pairs), ("elites", pa.list_(pa.binary())), ("fitness", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    rng = np.random.default_rng([seed, epoch, r["island"]])
                    pieces = {x["length"]: x["n"] for x in r["lengths"]}
                    found = evolve(pieces, capacity, sorted(set(r["elites"]))[:population], rng, population, generations)[:elites]
                    out.append(r | {"elites": [p.packed() for p in found], "fitness": list(found[0].fitness())})
                yield pa.RecordBatch.from_pylist(out, kind)

        return state.select("island", "lengths", "elites").mapInArrow(run, "island int, lengths array<struct<length: long, n: long>>, elites array<binary>, fitness array<long>")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, packer: IslandPacker | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    packer = packer or IslandPacker()
    pieces = durable(cut_pieces(docs, tokenizer_path, capacity=packer.capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return packer.pack(pieces)
