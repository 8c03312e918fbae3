"""LM scoring by cross-entropy difference.

Two word-pair models, of the target texts and of all texts, share one vocabulary (all words of all
documents), one order, one smoothing and one total mass (the background's counts are scaled to the
target's total, so that size alone makes no difference). A document's score is the mean over its tokens of
the target model's loss less the background model's: below zero, it is more like the target.

p(w | v) = (c(v, w) + mass * p(w)) / (c(v) + mass), with p(w) = (c(w) + 1) / (n + words + 1).

A document's own counts are left out of both models when it is scored, so that what it alone says helps it in
neither: a text that occurs twice is known to the background, one that occurs once is not.

Counts are exact and over all documents (keys are 64-bit hashes of words and pairs). Documents are taken in blocks
of about a million tokens, and the look-up goes by block, not by token: a block sends each of its distinct keys once,
sorted and packed, to the bucket of hashes that the key lies in. A bucket sums the counts of all blocks and
answers each with the totals in the order of its keys, so an answer names no keys. A block with its answers
is scored by itself; its texts wait in the shared folder meanwhile. What moves is a few bytes for each distinct key
of a block, there and back; nothing is broadcast, and the driver sees five totals. Buckets are as many as the texts'
size asks for, so none outgrows a task.

Defined cases: a null or empty text has no tokens, and losses and score 0; texts of any length are read
whole; a document is a target once, however often its label repeats; repeated documents count as often
as they come; without other target texts the target model is uniform; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import durable, forget_at_exit, shared_dir, texts, utf8
from granary.llm.url_filters import BloomCascade

#: A block is closed at so many tokens or documents, whichever comes first.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 50_000
#: Bytes of text for which a bucket of keys is opened.
BUCKET_BYTES = 16 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w) - (1 << 63)


#: Stands before the first word; no word holds a space.
START = word_hash(b" ")


class _Words:
    """Words of lower-cased texts as hashes; remembers what it has seen."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words, memo = raw.lower().split(), self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > 200_000:
                memo.clear()
                new = set(words)
            memo.update((w, word_hash(w)) for w in new)
        return np.array(list(map(memo.__getitem__, words)), np.int64)


def _before(found: list[np.ndarray]) -> np.ndarray:
    """The word before each word of some texts."""
    out = np.concatenate([np.array([START], np.int64), *found])[:-1]
    out[np.cumsum([0, *map(len, found[:-1])])] = START
    return out


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v.view(np.uint64) * _MIX + w.view(np.uint64)).view(np.int64)


class _Block:
    """The tokens of some documents, and their distinct keys in the order of the hashes taken as unsigned."""

    def __init__(self, ids: list[np.ndarray], target: np.ndarray):
        self.sizes = np.array([len(x) for x in ids], np.int64)
        some, self.full = [x for x in ids if len(x)], np.nonzero(self.sizes)[0]
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        w = np.concatenate(some) if some else np.zeros(0, np.int64)
        v = _before(some) if some else w
        self.own, self.own_full = target[self.doc], target[self.full]
        # words and starts of the documents together, as the word before may be either
        self.words, self.word_at = np.unique(np.append(w, np.full(len(self.full), START)).view(np.uint64), return_inverse=True)
        self.pairs, self.pair_at = np.unique(_pair(v, w).view(np.uint64), return_inverse=True)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """keys, how often, and how often in targets: of words with starts, and of pairs."""
        own = (np.append(self.own, self.own_full), self.own)
        out = []
        for keys, at, target in zip((self.words, self.pairs), (self.word_at, self.pair_at), own):
            out.append((keys, np.bincount(at, minlength=len(keys)), np.bincount(at, weights=target, minlength=len(keys)).astype(np.int64)))
        return out


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys: their lower 40 bits as they are, the steps of the upper 24 and the counts compressed."""
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    steps = np.diff(keys >> np.uint64(40), prepend=np.uint64(0)).astype("<u4")
    return len(keys).to_bytes(8, "little") + low + _squeeze(b"".join([steps.tobytes(), *(c.astype("<i8").tobytes() for c in counts)]))


def _unpacked(raw: bytes, counts: int) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(raw[:8], "little")
    rest = _expand(raw[8 + 5 * n :])
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 8).reshape(n, 5)
    high = np.cumsum(np.frombuffer(rest, "<u4", n), dtype=np.uint64) << np.uint64(40)
    return keys.view(np.uint64).reshape(n) | high, *(np.frombuffer(rest, "<i8", n, 4 * n + 8 * n * k) for k in range(counts))


_ASKED = "bucket long, block long, crc long, words binary, pairs binary"
_TOLD = "block long, crc long, bucket long, words binary, pairs binary, n long, t long, n_all long, t_all long, distinct long"
_TOLD_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _TOLD.split(", ")])


def _asking(folder: str, bits: int):
    """Blocks of documents: their rows to a file, their distinct keys to buckets (the first ``bits`` bits of the hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, number = _Words(), TaskContext.get().partitionId(), 0
        rows, ids, size = [], [], 0

        def close():
            table = pa.Table.from_batches(rows)
            block = _Block(ids, np.array(table.column(2).to_pylist(), np.int64))
            counts = block.counts()
            crc = zlib.crc32(block.pairs.tobytes(), zlib.crc32(block.words.tobytes()))
            name = part << 24 | number
            _write_block(f"{folder}/{name}-{crc}", table)
            borders = np.append(np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64), np.uint64(0))
            cuts = [np.append(np.searchsorted(keys, borders[:-1]), len(keys)) for keys, _, _ in counts]
            out = []
            for k in range(1 << bits):
                spans = [slice(c[k], c[k + 1]) for c in cuts]
                if k == 0 or any(x.stop > x.start for x in spans):  # the first bucket hears of every block, even of one without tokens
                    out.append((k, name, crc, *(_packed(keys[x], n[x], t[x]) for (keys, n, t), x in zip(counts, spans))))
            for at in range(0, len(out), 64):
                some = out[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], pa.int64() if c < 3 else pa.binary()) for c in range(5)], ["bucket", "block", "crc", "words", "pairs"])

        for b in batches:
            start = 0
            for at, raw in enumerate(utf8(b.column(1))):
                ids.append(split(raw))
                size += len(ids[-1])
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    rows.append(b.slice(start, at + 1 - start))
                    yield from close()
                    rows, ids, size, start, number = [], [], 0, at + 1, number + 1
            if start < b.num_rows:
                rows.append(b.slice(start))
        if ids:
            yield from close()
        pa.default_memory_pool().release_unused()

    return run


def _write_block(path: str, table: pa.Table) -> None:
    """Under its name when whole: a task that runs again writes the same."""
    system, place = fs.FileSystem.from_uri(path)
    staged = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(staged) as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        system.delete_file(place)
    system.move(staged, place)


def _answer(asked: pa.Table) -> pa.Table:
    """A bucket's totals, to each block in the order of its keys; with the first answer, the bucket's share of the corpus totals."""
    rows, known = asked.to_pylist(), {}
    spans = {c: [_unpacked(r[c], 2) for r in rows] for c in ("words", "pairs")}
    sums = [0] * 5
    for c, found in spans.items():
        keys, at = np.unique(np.concatenate([k for k, _, _ in found]), return_inverse=True)
        # counts stay far below 2**53, up to which sums of doubles are exact
        n, t = (np.bincount(at, weights=np.concatenate([x[i] for x in found]), minlength=len(keys)).astype(np.int64) for i in (1, 2))
        if c == "words":
            is_word = keys != np.int64(START).view(np.uint64)
            sums = [int(n[is_word].sum()), int(t[is_word].sum()), int(n.sum()), int(t.sum()), int(is_word.sum())]
        ends = np.cumsum([0, *(len(k) for k, _, _ in found)])
        known[c] = [_squeeze(n[at[a:z]].astype("<i8").tobytes() + t[at[a:z]].astype("<i8").tobytes()) for a, z in zip(ends[:-1], ends[1:])]
    out = [(r["block"], r["crc"], r["bucket"], w, p, *(sums if i == 0 else [0] * 5)) for i, (r, w, p) in enumerate(zip(rows, known["words"], known["pairs"]))]
    return pa.Table.from_pydict({f.name: pa.array([r[k] for r in out], f.type) for k, f in enumerate(_TOLD_ARROW)}, _TOLD_ARROW)


def _marked(base: DataFrame, targets: DataFrame) -> DataFrame:
    """base with a column target: whether doc_id is a target.

    The target ids are a list over the universe of all doc_ids, so a filter cascade tells exactly, without
    moving any text; a list beyond the cascade's bound is joined, with the same result.
    """
    chosen = targets.select(F.col("doc_id").cast("long").cast("string").alias("key"))
    key = F.col("doc_id").cast("string")
    cascade = BloomCascade().build(chosen, base.select(key.alias("key")))
    if cascade.fits:
        return cascade.attach(base, "__level").withColumn("target", cascade.contains(key, "__level"))
    return base.join(chosen.distinct().select(F.col("key").cast("long").alias("doc_id"), F.lit(True).alias("target")), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


_SCORED = "doc_id long, n_tokens long, loss_target double, loss_background double"


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, *, mass: float = 50.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of every row. targets: doc_id of the target texts."""
    spark = docs.sparkSession
    base = texts(docs, id_col=id_col, text_col=text_col)
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    folder = f"{shared_dir(spark)}/granary-blocks-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = _marked(base, targets).select("doc_id", "text", F.col("target").cast("boolean").alias("target"))
    asked = marked.mapInArrow(_asking(folder, bits), _ASKED)
    told = durable(asked.repartition(max(tasks, 1 << bits), "bucket").groupBy("bucket").applyInArrow(_answer, _TOLD), "counts")
    total = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "t", "n_all", "t_all", "distinct"))).first()
    n_words, scale = total[4], total[3] / total[2] if total[2] and total[3] else 1.0
    n_target, n_background = float(total[1]), float(total[0])

    def score(answers: pa.Table) -> pa.Table:
        rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        own, path = fs.FileSystem.from_uri(f"{folder}/{rows[0]['block']}-{rows[0]['crc']}")
        with own.open_input_file(path) as f:
            table = pa.ipc.open_file(f).read_all()
        split = _Words()
        ids = [split(raw) for raw in utf8(table.column(1))]
        block = _Block(ids, np.array(table.column(2).to_pylist(), np.int64))
        counts = []
        for c, keys in (("words", block.words), ("pairs", block.pairs)):
            both = [np.frombuffer(_expand(r[c]), "<i8").reshape(2, -1) for r in rows]
            n, t = np.concatenate(both, axis=1)
            if len(n) != len(keys):
                raise RuntimeError("a block has not got an answer for each of its keys: its input changed between runs of a task")
            counts.append((n, t))

        def of(which: int, at: np.ndarray, doc: np.ndarray):
            """Of each occurrence: counts in all texts and in targets, and how often its document has it."""
            n, t = counts[which]
            _, back, times = np.unique(doc * len(n) + at, return_inverse=True, return_counts=True)
            return n[at], t[at], times[back]

        doc, full, sizes, m = block.doc, block.full, block.sizes, len(block.doc)
        n1, t1, o1 = of(0, block.word_at, np.append(doc, full))
        n2, t2, o2 = of(1, block.pair_at, doc)
        before = np.arange(m) - 1  # where the word before is
        before[np.cumsum(np.append(0, sizes[full][:-1]))[: len(full)]] = m + np.arange(len(full))
        losses, mine_1 = [], np.append(block.own, block.own_full)
        for f, n, two, one, mine in ((1.0, n_target, t2 - block.own * o2, t1 - mine_1 * o1, block.own), (scale, n_background, n2 - o2, n1 - o1, 1)):
            p_word = (f * one[:m] + 1) / (f * (n - mine * sizes[doc]) + n_words + 1)
            loss = np.log(f * one[before] + mass) - np.log(f * two + mass * p_word)
            losses.append(np.bincount(doc, loss, len(ids)) / np.maximum(sizes, 1))
        return pa.table([table.column(0), pa.array(sizes), *map(pa.array, losses)], ["doc_id", "n_tokens", "loss_target", "loss_background"])

    scored = told.drop("n", "t", "n_all", "t_all", "distinct").repartition(tasks, "block", "crc").groupBy("block", "crc").applyInArrow(score, _SCORED)
    return scored.withColumn("score", F.col("loss_target") - F.col("loss_background"))
