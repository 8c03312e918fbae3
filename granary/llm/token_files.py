"""Token ids of a corpus as flat binary files: little-endian unsigned integers, with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id, and each range is encoded and written by one task
as a shard of three files: ``.ids`` (the ids of all its documents one after another, 16 bits each where
the vocabulary allows, else 32), ``.docs`` (a signed 64-bit doc_id for each) and ``.lens`` (an unsigned
64-bit count of ids for each). A task cannot know how many ids other ranges hold: the bases of the shards
are prefix sums over one row a shard, and with them ``.off`` (unsigned 64-bit, one more than documents)
gets the place of each document in the whole corpus. Shards in the order of the manifest and put end to end
are one file, which its offsets fit.

A shard's name holds a random part, so a task that runs twice never writes over itself; the manifest, a
table that Spark commits, names the shards that count. Files that it does not name come from lost attempts.
Files are written where :mod:`pyarrow.fs` can (local and mounted folders, HDFS, object stores) and read by
memory map where the folder is mounted, else by ranges.

Defined cases: a null text is empty (its ids are the end id alone); null doc_ids come first and are written
as ``NO_ID``; rows of one doc_id are ordered by a hash of their text, equal rows are interchangeable; texts
of any length are encoded whole; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import common

#: Stands in ``.docs`` for a null doc_id.
NO_ID = -(1 << 63)
#: Chunks that a worker remembers before it starts anew. A memo only: it changes no result.
MEMO_ENTRIES = 1_000_000
#: Words encoded as one text, to spare the cost of a call.
JOINED = 256
#: Ids read at a time where files cannot be memory-mapped.
READ_IDS = 1 << 22


class Encoder:
    """Ids by a ``tokenizers`` file, without special tokens added.

    A byte-level vocabulary with word ends and one split pattern that keeps no white space is encoded by
    chunks between ASCII blanks, each distinct chunk once: its words are found with the file's own pattern
    and given to the file's own model, many in a call. Chunks with characters that the normaliser changes
    other than to lower case, or that hold a special token, go to the whole tokeniser. Files of
    any other form are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        self.pattern = _words_pattern(raw)
        self.memo: dict[str, bytes] = {}
        if self.pattern is not None:
            self._prepare(raw)

    def _prepare(self, raw: dict) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.words = Tokenizer.from_str(json.dumps(raw | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        normal = self.tokenizer.normalizer.normalize_str
        plain = [c for c in map(chr, range(0x21, 0x250)) if len(c.lower()) == 1 and c.lower() < "\u0250" and normal(f"a{c}a") == f"a{c.lower()}a" and not c.isspace()]
        self.bytes = {ord(c): "".join(x for x, _ in visible.pre_tokenize_str(c)) for c in plain}
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        odd = "[^" + "".join(map(regex.escape, plain)) + "]"
        self.odd = regex.compile("|".join([odd, *special]))
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.word_memo: dict[str, bytes] = {}

    def _bytes_of(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _encode_words(self, words: list[str]) -> None:
        """Puts the ids of words into the memo: joined by blanks, parted again where a token ends a word."""
        texts = [" ".join(words[k : k + JOINED]).translate(self.bytes) for k in range(0, len(words), JOINED)]
        for at in range(0, len(texts), 64):
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.words.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)])
            some = words[at * JOINED : (at + 64) * JOINED]
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) != len(some):
                raise ValueError("the model's tokens do not end where words do")
            raw = ids.tobytes()
            self.word_memo.update(zip(some, (raw[a:z] for a, z in zip([0, *cuts], cuts))))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        memo, out = self.memo, list(map(self.memo.get, chunks))
        new = [k for k, x in enumerate(out) if x is None]
        if not new:
            return out
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
            self.word_memo.clear()
        odd = [k for k in new if self.odd.search(chunks[k])]
        away = set(odd)
        parts = {k: [w] if (w := chunks[k].lower()).isalpha() else self.pattern.findall(w) for k in new if k not in away}
        known = self.word_memo
        if wanted := list({w for p in parts.values() for w in p if w not in known}):
            self._encode_words(wanted)
        for k, p in parts.items():
            out[k] = known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p))
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([chunks[k] for k in odd], add_special_tokens=False)):
            out[k] = self._bytes_of(e.ids)
        memo.update((chunks[k], out[k]) for k in new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if self.pattern is None:
            each = [self._bytes_of(e.ids) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.frombuffer(b"".join(each), self.dtype), np.array([len(x) // self.dtype.itemsize for x in each], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        each = self._chunks(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        length = np.array([len(x) // self.dtype.itemsize for x in each], np.int64)
        values, starts = np.frombuffer(b"".join(each), self.dtype), np.cumsum(length) - length
        own = length[code] if len(code) else np.zeros(0, np.int64)
        ends = np.cumsum(own)
        ids = values[np.repeat(starts[code] - (ends - own), own) + np.arange(ends[-1])] if len(code) else values
        total, border = np.append(0, ends), split.offsets.to_numpy()
        return ids, np.diff(total[border - border[0]])


def _words_pattern(raw: dict) -> regex.Pattern | None:
    """The pattern that finds a file's words, if the file has the form that allows chunks."""
    pre, norm, model = raw.get("pre_tokenizer") or {}, raw.get("normalizer") or {}, raw["model"]
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in norm.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or model.get("end_of_word_suffix") != "</w>" or raw.get("post_processor"):
        return None
    first, *rest = pre.get("pretokenizers", [{}])
    if [x.get("type") for x in rest] != ["ByteLevel"] or rest[0]["use_regex"] or rest[0]["add_prefix_space"] or first.get("type") != "Split" or not first["invert"] or first["behavior"] != "Removed":
        return None
    return regex.compile(first["pattern"]["Regex"])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(path: str, content: np.ndarray) -> None:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(place) as out:
        out.write(np.ascontiguousarray(content))


def _read(path: str, kind: str) -> np.ndarray:
    """A whole file: mapped where it can be, else read."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, kind, "r") if os.path.getsize(place) else np.zeros(0, kind)
    with system.open_input_file(place) as f:
        return np.frombuffer(f.read(), kind)


SHARDS = "part int, shard string, n_docs long, n_ids long, dtype string"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes a corpus into files in ``folder`` (default: a new one in the shared folder, deleted when the driver ends).

    Returns the manifest: part, shard (path without ending), n_docs, n_ids, dtype, base (ids of all shards before it).
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{common.shared_dir(spark)}/granary-tokens-{uuid.uuid4().hex}"
        common.forget_at_exit(spark, folder)
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place)
    rows = common.texts(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        bpe, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        shard = f"{folder}/{part:06d}-{uuid.uuid4().hex}"
        own, to = fs.FileSystem.from_uri(shard)
        names, lengths, b = [], [], first
        with own.open_output_stream(f"{to}.ids") as out:
            while b is not None:
                for at in range(0, b.num_rows, 2000):
                    some = b.slice(at, 2000)
                    ids, n = bpe.encode(some.column(1))
                    ends = np.insert(ids, np.cumsum(n), np.array(end_id, bpe.dtype))
                    out.write(np.ascontiguousarray(ends))
                    names.append(pc.fill_null(some.column(0), NO_ID).to_numpy())
                    lengths.append(n + 1)
                b = next((b for b in batches if b.num_rows), None)
        names, lengths = np.concatenate(names), np.concatenate(lengths)
        _write(f"{shard}.docs", names.astype("<i8"))
        _write(f"{shard}.lens", lengths.astype("<u8"))
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(names), "n_ids": int(lengths.sum()), "dtype": bpe.dtype.str}], pa.schema([("part", pa.int32()), ("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("dtype", pa.string())]))

    written = common.durable(rows.mapInArrow(run, SHARDS), "token-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    manifest = common.durable(_dealt(based, written.count()).mapInArrow(_write_offsets, SHARDS + ", base long"), "token-manifest")
    common.discard(written)
    return manifest


def _dealt(manifest: DataFrame, shards: int) -> DataFrame:
    """As many tasks as shards: their rows are too short to tell how much work they stand for."""
    return manifest.repartitionByRange(max(1, shards), "part")


def _write_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard: where its documents start in the whole corpus, and where the last one ends."""
    for b in batches:
        for r in b.to_pylist():
            lengths = _read(f"{r['shard']}.lens", "<u8")
            _write(f"{r['shard']}.off", np.cumsum(np.append(np.uint64(r["base"]), lengths), dtype="<u8"))
        yield b


def _ids(shard: str, kind: str, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of a shard's documents, by where they start in its file."""
    system, place = fs.FileSystem.from_uri(f"{shard}.ids")
    if isinstance(system, fs.LocalFileSystem):
        flat = _read(f"{shard}.ids", kind)
        yield from (flat[a:z] for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()))
        return
    size = np.dtype(kind).itemsize
    with system.open_input_file(place) as f:
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_IDS, "right")) - 1)
            block = np.frombuffer(f.read_at(int(starts[to] - starts[at]) * size, int(starts[at]) * size), kind)
            yield from (block[a:z] for a, z in zip((starts[at:to] - starts[at]).tolist(), (starts[at + 1 : to + 1] - starts[at]).tolist()))
            at = to


def read_token_files(spark: SparkSession, manifest: DataFrame, *, keep_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), and the ids if ``keep_ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                docs, off = _read(f"{r['shard']}.docs", "<i8"), _read(f"{r['shard']}.off", "<u8").astype(np.int64)
                found = _ids(r["shard"], r["dtype"], off - off[0])
                for at in range(0, len(docs), 5000):
                    some = docs[at : at + 5000]
                    wide = [next(found).astype("<u4") for _ in some]
                    place = off[at : at + len(some) + 1]
                    columns = [pa.array(some, pa.int64(), mask=some == NO_ID), pa.array(place[:-1]), pa.array(np.diff(place)), pa.array([zlib.crc32(x) for x in wide], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns, names = [*columns, pa.array([x.astype(np.int32) for x in wide], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return _dealt(manifest, manifest.count()).mapInArrow(run, schema)
