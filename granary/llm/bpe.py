"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A vocabulary's byte strings are mapped to Latin-1, so that an Aho-Corasick automaton over them finds
the longest token that starts at each byte. A piece of text is encoded left to right: the longest
match is tried first, and given up for the next shorter one (or for a token before it) when two
adjacent tokens could not stand together, that is, when merging their joined bytes by rank would give
other tokens. These answers are memoised, and each byte position is left at most once, so the time is
linear in the piece's length. The result equals merging by rank.

Defined cases: a null text is empty (no ids, digests of nothing); text of any length is encoded
whole; equal rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, texts

#: Entries that a task keeps of encoded chunks before it starts anew. A memo only: it changes no result.
MEMO_ENTRIES = 600_000


class BytePairCodec:
    """Encodes and decodes bytes with the ranks in a ``.tiktoken`` file (base64 token, rank)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: dict[int, bytes] = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._split: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._extra = {v: len(k) - 1 for k, v in self.ranks.items()}
        self._longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self._shorter: dict[int, int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if self._reachable(token, rank):
                self._longest.add_word(token.decode("latin-1"), rank)
        for token, rank in self.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (r := self.ranks.get(token[:n])) is not None and (n == 1 or r in self._split):
                    self._shorter[rank] = r
                    break
        self._longest.make_automaton()
        self.memo: dict[str, bytes] = {}
        self._pack = struct.pack
        self._piece = lru_cache(1 << 18)(lambda m: self.encode_piece(m.encode()))

    def _reachable(self, token: bytes, rank: int) -> bool:
        """Whether merging a token's bytes gives the token; keeps the two tokens that the last merge joins."""
        if len(token) == 1:
            return True
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        self._split[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay as they are when their joined bytes are merged."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            known = self._fits[key] = self._judge(left, right)
        return known

    def _judge(self, left: int, right: int) -> bool:
        # Undo the younger merge on either side of the border, step by step. At each step, the two tokens
        # beside the border stood together before rank `limit`: an older rank that joins them came first.
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            undo_left = left in self._split and (left > right or right not in self._split)
            if undo_left:
                limit, left = left, self._split[left][1]
            elif right in self._split:
                limit, right = right + 1, self._split[right][0]  # of equal ranks the one further left merges first
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, extra, fits = len(piece), self._extra, self._fits
        longest = [-1] * n
        for end, rank in self._longest.iter(piece.decode("latin-1")):  # by rising end: the last for a start is its longest
            longest[end - extra[rank]] = rank
        ids: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token, last = 0, longest[0], -1
        while token >= 0:
            end = at + extra[token] + 1
            if open_at[end] and (last < 0 or (ok := fits.get(last << 32 | token)) or ok is None and self.fits(last, token)):
                ids.append(token)
                at, last, token = end, token, longest[end] if end < n else -1
            elif token in self._shorter:
                token = self._shorter[token]
            else:  # nothing can start here after what stands before: give up the token before
                open_at[at] = 0
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of the text")
                token = ids.pop()
                at -= extra[token] + 1
                last = ids[-1] if ids else -1
        if at != n:
            raise ValueError("the vocabulary lacks a byte of the text")
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, each match of the pattern separately."""
        memo = self.memo
        chunks = chunked(text)
        new = set(chunks).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = set(chunks)
            piece, pack = self._piece, self._pack
            for c in new:
                if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()):  # the pattern's ` ?\p{L}+` matches all of it
                    ids = piece(c)
                else:
                    ids = [i for m in self.pattern.findall(c) for i in piece(m)]
                memo[c] = pack("<%dI" % len(ids), *ids)
        return b"".join(map(memo.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: A blank after a visible ASCII character always starts a new match of the patterns of the public byte-level vocabularies.
_CUT = re.compile(r"(?<=[!-~])(?= )")
_MIXED = re.compile(r"\s ")


def chunked(text: str) -> list[str]:
    """Cuts a text where a match of the split pattern must end: before a blank that follows a non-blank.

    No alternative of the pattern holds a blank after a non-blank, and its look-ahead asks only about
    the end of a run of white space, so chunks can be split and encoded apart, and remembered.
    """
    if _MIXED.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(ranks_path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker and vocabulary."""
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = BytePairCodec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids (array of int) if ``keep_ids``.

    One pass without a shuffle. ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers,
    ``decoded_sha256`` of the bytes that the ids decode to (equal to the text's own digest).
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def make():
        bpe = codec(ranks_path, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), np.frombuffer(ids, "<i4") if keep_ids else None))
            columns = [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array([r[3] for r in rows], pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        return run

    return arrow_map(texts(docs, id_col=id_col, text_col=text_col), make, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text, from an array of ids; bytes that are not UTF-8 become U+FFFD. Null ids give an empty text."""

    def make():
        bpe = codec(ranks_path, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [b"".join(map(bpe.tokens.__getitem__, ids or ())).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

        return run

    return arrow_map(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), make, "doc_id long, text string")
