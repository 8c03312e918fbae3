import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import entry, token_files

PATH = P.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = token_files.Encoder(PATH)
OTHER = P.path("byte_bpe_50k.json")


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab'stréÑ 0١\n\t\x0b\x1c\x85\xa0é́ΣİǅK_#<|endoftext|>", max_size=40)), max_size=5))
def test_encodes_as_the_library(texts):
    ids, n = ENCODER.encode(pa.array(texts, pa.string()))
    want = [plain(t) for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_special_tokens_and_the_memo(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_ENTRIES", 3)
    texts = ["a<|endoftext|>b c", "<|startoftext|>", "x0y 10 can't I'LL", "ﬁ ſ Å"] * 3
    for _ in range(2):
        ids, _ = ENCODER.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in plain(t)]


def test_another_form_of_file():
    other = token_files.Encoder(OTHER)
    assert other.pattern is None
    ids, n = other.encode(pa.array(["one two", None, "<|endoftext|>x"]))
    want = [Tokenizer.from_file(OTHER).encode(t, add_special_tokens=False).ids for t in ("one two", "", "<|endoftext|>x")]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


def key(i):
    return -(1 << 63) if i is None else i


def test_files(spark, odd_docs, no_docs):
    manifest = token_files.write_token_files(odd_docs.repartition(3), PATH, 1)
    shards = sorted(manifest.collect(), key=lambda r: r["part"])
    got = token_files.read_token_files(spark, manifest, keep_ids=True).collect()
    got.sort(key=lambda r: r["start"])
    assert [key(r["doc_id"]) for r in got] == sorted(key(r["doc_id"]) for r in odd_docs.collect())
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert sorted((key(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((key(r["doc_id"]), (*plain(r["text"]), 1)) for r in odd_docs.collect())
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"]) for r in got)
    # shards put end to end are one flat file, which the offsets fit
    flat = np.concatenate([np.fromfile(s["shard"].removeprefix("file://") + ".ids", "<u2") for s in shards])
    off = [np.fromfile(s["shard"].removeprefix("file://") + ".off", "<u8") for s in shards]
    assert len(flat) == sum(s["n_ids"] for s in shards) and all(a[-1] == b[0] for a, b in zip(off, off[1:])) and off[-1][-1] == len(flat)
    for r in got:
        assert flat[r["start"] : r["start"] + r["n_tokens"]].tolist() == r["ids"]
    empty = token_files.write_token_files(no_docs, PATH, 1)
    assert empty.count() == 0 and token_files.read_token_files(spark, empty).count() == 0


def test_reading_by_ranges(spark, odd_docs, monkeypatch):
    """Where a folder is not mounted: the same ids, read by ranges."""
    (shard,) = token_files.write_token_files(odd_docs.coalesce(1).limit(12), PATH, 1).orderBy("part").limit(1).collect()
    off = token_files._read(shard["shard"] + ".off", "<u8").astype(np.int64)
    mapped = [x.tolist() for x in token_files._ids(shard["shard"], shard["dtype"], off - off[0])]
    monkeypatch.setattr(token_files, "READ_IDS", 7)
    monkeypatch.setattr(token_files.fs, "LocalFileSystem", int)
    assert [x.tolist() for x in token_files._ids(shard["shard"], shard["dtype"], off - off[0])] == mapped


def test_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    start = 0
    got = {r["doc_id"]: r for r in entry.queries()["op11_token_files"](spark, small).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array([*plain(docs[i]), 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
