import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.BytePairCodec(PATH, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab cd\n\t'sret.,!é　\x1c\x85 1", max_size=60), st.lists(st.sampled_from([k.decode("utf-8", "ignore") for k in list(RANKS)[::37]]), max_size=6).map("".join)))
def test_encodes_as_merging_by_rank(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pieces_take_linear_time():
    text = "a" * 20000 + "ab" * 20000
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_documents(spark, odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, PATH, P.PATTERN)
    rows = {(r["doc_id"], r["n_tokens"]): r for r in got.collect()}
    assert got.count() == odd_docs.count()
    for r in odd_docs.collect():
        ids = np.array(PLAIN.encode_ordinary(r["text"] or ""), "<u4")
        x = rows[r["doc_id"], len(ids)]
        assert x["ids"] == ids.tolist() and x["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest() and x["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode_documents(got, PATH, P.PATTERN)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in back.collect()) == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd_docs.collect())
    assert bpe.encode_documents(no_docs, PATH, P.PATTERN).count() == 0
