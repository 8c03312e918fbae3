"""What each of several document filters removes, in every order in which they can be applied.

Every document gets a mask of the conditions that it fails: too few words (A), too few distinct words
(B), too many capitals (C), a forbidden symbol (D), a text that a smaller doc_id has, too (E). Duplicates are
found by sorting: rows are range-partitioned by (fingerprint of the text, doc_id), sorted by fingerprint,
whole text and doc_id, and compared with the row before. A run of equal texts that a border of ranges cuts
is mended afterwards: a range tells the first doc_id of each text that stood at its end, and the first rows
of a range, narrow by then, are looked up there. So copies by the thousand are dealt over ranges like any rows.

Masks merge into additive counters: documents by (part, mask), with those of good and of toxic labels. All
figures of all orders follow from one number for each set S of filters, the documents that fail none of S:
a filter f after the filters P keeps clear(P + f) and removes clear(P) - clear(P + f).

Defined cases: a null text is empty and equals other empty texts; a null part is the empty string; a null
doc_id is neither smaller nor larger than another, so such a row never fails E, and it has no labels; rows of
one doc_id with one text do not fail E by each other; of several labels of a doc_id any that says 1 counts; texts of any length
are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common

LETTERS = "ABCDE"
_ALL = (1 << len(LETTERS)) - 1
_DUPLICATE = 1 << LETTERS.index("E")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Conditions:
    """When a document fails A to D; all shares in per cent."""

    least_words: int = 100
    least_distinct: int = 80
    most_capitals: int = 10
    symbols: bytes = b"#$%&*|"

    def mask(self, text: bytes, code_points: int) -> int:
        words = text.split()
        n = len(words)
        capitals = len(text) - len(text.translate(None, _CAPITALS))
        return (
            (n < self.least_words)
            | (100 * len(set(words)) < self.least_distinct * n) << 1
            | (100 * capitals > self.most_capitals * code_points) << 2
            | (len(text.translate(None, self.symbols)) < len(text)) << 3
        )


#: doc: a document and its mask. head: the same where earlier ranges may hold its text. border: a text at a range's end and its first doc_id.
_FOUND = "kind string, doc_id long, part string, mask int, digest binary"
_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def failure_masks(docs: DataFrame, part: Column | str = "lang", conditions: Conditions = Conditions(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part and mask (bit 0: A, ... bit 4: E) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit("")).alias("part"))
    number = F.col("doc_id").asc_nulls_last()
    dealt = rows.withColumn("print", F.xxhash64("text")).repartitionByRange("print", number).sortWithinPartitions("print", "text", number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # fingerprints: the range's first, that of the row before
        text, least, ends = None, None, []  # the run of equal texts: its text, its first doc_id; such pairs of the last fingerprint
        for b in batches:
            kinds, masks, digests = [], [], []
            points = pc.utf8_length(b.column("text")).to_pylist()
            for i, t, n, p in zip(b.column("doc_id").to_pylist(), common.utf8(b.column("text")), points, b.column("print").to_pylist()):
                if p != last:
                    ends, text = [], None
                    first, last = p if first is None else first, p
                mask, kind, digest = conditions.mask(t, n), "doc", None
                if t != text:
                    text, least = t, i
                    ends.append((text, least))
                if i is not None and least < i:
                    mask |= _DUPLICATE
                elif i is not None and p == first:
                    kind, digest = "head", hashlib.sha256(t).digest()
                kinds.append(kind)
                masks.append(mask)
                digests.append(digest)
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], schema=_ARROW)
        borders = [{"kind": "border", "doc_id": i, "part": None, "mask": 0, "digest": hashlib.sha256(t).digest()} for t, i in ends if i is not None]
        pa.default_memory_pool().release_unused()
        if borders:
            yield pa.RecordBatch.from_pylist(borders, _ARROW)

    found = common.durable(dealt.select("doc_id", "text", "part", "print").mapInArrow(run, _FOUND), "failure-masks")
    borders = found.filter("kind = 'border'").groupBy("digest").agg(F.min("doc_id").alias("least"))
    heads = found.filter("kind = 'head'").groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(borders, "digest", "left")
    mended = F.col("mask").bitwiseOR(F.when(F.col("least") < F.col("doc_id"), _DUPLICATE).otherwise(0))
    alike = heads.select("doc_id", "part", mended.alias("mask"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).drop("k")
    return found.filter("kind = 'doc'").select("doc_id", "part", "mask").unionByName(alike)


def count_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counters, by what ``labels`` (doc_id, quality, toxic) says of the documents."""
    of = F.col("doc_id").cast("long").alias("doc_id")
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(of).agg(F.max(F.col("quality").eqNullSafe(1).cast("long")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("long")).alias("toxic"))
    said = said.filter("good + toxic > 0")
    once = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # a doc_id of very many rows is one row from here
    sums = [F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic"))]
    return once.join(said, "doc_id", "left").groupBy("part", "mask").agg(*sums)


def _steps() -> list[dict]:
    """Every order of the filters, step by step: the sets of filters before and after each."""
    out = []
    for order in map("".join, itertools.permutations(LETTERS)):
        before = 0
        for k, letter in enumerate(order):
            own = 1 << LETTERS.index(letter)
            out.append({"filter_order": order, "step": k + 1, "own": own, "before": before})
            before |= own
    return out


def interactions(counters: DataFrame) -> DataFrame:
    """From the counters of :func:`count_masks`: a row for each part, order of the filters and step, zeros included."""
    sets = F.filter(F.sequence(F.lit(0), F.lit(_ALL)), lambda s: s.bitwiseAND(F.col("mask")) == 0)
    clear = counters.select("part", F.explode(sets).alias("set"), "n", "good", "toxic").groupBy("part", "set").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    by_set = clear.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic")))).alias("clear"))  # 32 sets at most
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, own int, before int>>")
    rows = by_set.select("part", "clear", F.inline(steps))

    def failing_none(which: Column, count: str = "n") -> Column:
        return F.coalesce(F.try_element_at("clear", which)[count], F.lit(0).cast("long"))

    own, before, after = F.col("own"), F.col("before"), F.col("before").bitwiseOR(F.col("own"))
    removed = failing_none(before) - failing_none(after)
    out = rows.select(
        "part", "filter_order", "step", "own", failing_none(after).alias("kept"), removed.alias("removed"),
        (failing_none(F.lit(0)) - failing_none(own) - removed).alias("redundant"), (failing_none(F.lit(_ALL) - own) - failing_none(F.lit(_ALL))).alias("unique_fails"),
        *((failing_none(before, c) - failing_none(after, c)).alias(f"{c}_lost") for c in ("good", "toxic")),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit_filters(docs: DataFrame, labels: DataFrame, part: Column | str = "lang", conditions: Conditions = Conditions(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole audit: masks, counters, and the figures of every order."""
    return interactions(count_masks(failure_masks(docs, part, conditions, id_col=id_col, text_col=text_col), labels))
