"""Exact top-k inner products, with pruning by norms and rotated partial sums.

Components become integers, floor(1024 * x). The candidates' second-moment matrix (summed over all
rows) gives a rotation, by singular value decomposition, that puts most of a product into the first
coordinates. Candidates are dealt into levels of descending norm and these into blocks; inside a block
they are visited by descending norm, too. A query's product with a candidate is at most (Cauchy-Schwarz)

* the product of their norms, which ends a search early and skips whole levels, and
* the product over the first ``head`` rotated coordinates plus the product of the norms of the rest,
  which leaves only few candidates to multiply in full, in integers.

Two rounds: each query meets the level of the highest norms first, which gives it a threshold (its
k-th best so far); it then goes only to levels whose bound reaches that threshold. Queries that reach
equally far share a group. Groups and blocks meet on a grid: blocks are dealt to columns, a group is sent
once to each column and a block once to each group that reaches it. A cell of the grid holds one group
of at most ``query_rows`` queries and reads its blocks one after another, so its memory is bounded.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a shorter
vector counts as filled up with zeros, so an empty one scores 0; every row is a candidate of its own,
also where a vec_id repeats, and each query row that repeats a vec_id has its own results; a row without
vec_id is a candidate (after all others of its score), not a query; equal scores go to the smaller vec_id;
with fewer than k candidates all are returned; components and scores beyond the range of a long are held
at its ends; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import durable

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_RESULT = "quid long, query_id long, uid long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """uid (a number of the row, below zero without vec_id), vec_id and v (array of long) of every row that takes part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    whole = base.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    low, high = F.lit(_LEAST), F.lit(_MOST)
    ints = F.transform("x", lambda c: F.when(c * scale >= 2.0**63, high).when(c * scale <= -(2.0**63), low).otherwise(F.floor(F.when(F.abs(c * scale) < 2.0**63, c * scale))))
    number = F.monotonically_increasing_id()
    return whole.select(F.when(F.col("vec_id").isNull(), -1 - number).otherwise(number).alias("uid"), "vec_id", ints.alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    n = len(column)
    if len(flat) and (np.diff(offsets) == d).all():
        return flat[offsets[0] : offsets[-1]].reshape(n, d)
    out = np.zeros((n, d), np.int64)
    for i in range(n):
        out[i, : offsets[i + 1] - offsets[i]] = flat[offsets[i] : offsets[i + 1]]
    return out


def rotation(ints: DataFrame, d: int) -> np.ndarray:
    """Orthogonal columns by falling singular value, from the second moments of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b.column(0), d).astype(float)
            total += x.T @ x
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "g"])

    sums = ints.select("v").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # d * d rows
    gram = np.zeros((d, d))
    for r in sums:
        gram[r["i"], r["j"]] = r["g"]
    return np.linalg.svd(gram)[0]


def _multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, held within a long: by the fastest arithmetic that no sum can leave."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Search:
    """The k best candidates of some queries, over blocks visited one after another.

    low: a score that each query has k times already. Candidates that score below it are of no use.
    """

    def __init__(self, uid: np.ndarray, q: np.ndarray, low: np.ndarray, turn: np.ndarray, k: int, head: int):
        self.uid, self.q, self.low, self.turn, self.k, self.head = uid, q, low.copy(), turn, k, head
        self.turned = q @ turn
        self.norm = np.sqrt((self.turned**2).sum(1))
        self.rest = np.sqrt((self.turned[:, head:] ** 2).sum(1))
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in uid]  # (-score, vec_id, -uid), sorted

    def visit(self, uid: np.ndarray, vec_id: np.ndarray, c: np.ndarray, step: int = 512) -> None:
        head = self.head
        cr = c @ self.turn
        norm = np.sqrt((cr**2).sum(1))
        by = np.argsort(-norm, kind="stable")
        uid, vec_id, c, cr, norm = uid[by], vec_id[by], c[by], cr[by], norm[by]
        rest = np.sqrt((cr[:, head:] ** 2).sum(1))
        for at in range(0, len(uid), step):
            to = min(at + step, len(uid))
            least = np.where(self.low == _LEAST, -np.inf, self.low.astype(float))
            slack = 1e-9 * self.norm * norm[at] + 1e-6  # more than rounding can amount to
            live = np.nonzero(self.norm * norm[at] + slack >= least)[0]
            if not len(live):
                return
            bound = self.turned[live, :head] @ cr[at:to, :head].T + np.outer(self.rest[live], rest[at:to]) + slack[live, None]
            may = bound >= least[live, None]
            rows, columns = np.nonzero(may.any(1))[0], np.nonzero(may.any(0))[0]
            if not len(rows):
                continue
            for r, own in zip(rows, _multiplied(self.q[live[rows]], c[at + columns])):
                i = live[r]
                good = np.nonzero(may[r, columns] & (own >= self.low[i]) & (uid[at + columns] != self.uid[i]))[0]
                if len(good):
                    self._take(i, own[good], at + columns[good], vec_id, uid)

    def _take(self, i: int, score: np.ndarray, place: np.ndarray, vec_id: np.ndarray, uid: np.ndarray) -> None:
        k = self.k
        if len(score) > 4 * k:  # ties at the border are all kept here, and sorted out below
            some = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, place = score[some], place[some]
        found = sorted(self.best[i] + [(-s, v, -u) for s, v, u in zip(score.tolist(), vec_id[place].tolist(), uid[place].tolist())])[:k]
        self.best[i] = found
        if len(found) == k:
            self.low[i] = max(int(self.low[i]), -found[-1][0])


@dataclass
class TopK:
    """Parameters of the search."""

    k: int = 10
    block_rows: int = 2048
    query_rows: int = 2048
    column_blocks: int = 8
    levels: int = 32
    head: int = 16

    def search(self, ints: DataFrame, is_query: Column) -> DataFrame:
        """ints: from :func:`integer_vectors`. query_id, rank (from 1), vec_id, score."""
        ints = durable(ints, "vectors")
        spark = ints.sparkSession
        seen = ints.agg(F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
        if not seen["n"]:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        d = max(1, seen["d"])
        turn = rotation(ints, d)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        normed = ints.withColumn("norm", F.sqrt(square))
        cuts = sorted(set(normed.approxQuantile("norm", [i / self.levels for i in range(1, self.levels)], 0.002)), reverse=True)
        # level 0 holds the highest norms; equal norms share a level, which is cut by hash as its size asks
        level = F.lit(0)
        for cut in cuts:
            level = level + (F.col("norm") <= cut).cast("int")
        levels = {r["level"]: r for r in normed.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}  # at most `levels` rows
        order = sorted(levels)
        parts = {k: -(-levels[k]["n"] // self.block_rows) for k in order}
        before = {k: sum(parts[j] for j in order if j < k) for k in order}
        dealt = normed.withColumn("level", level).withColumn("part", F.pmod(F.xxhash64("uid"), _of(parts)).cast("int"))
        blocks = durable(self._packed(dealt, "level", "part"), "blocks").withColumn("number", _of(before) + F.col("part"))

        queries = normed.filter(is_query).withColumn("low", F.lit(_LEAST))
        n = queries.count()
        groups = self._grouped(queries.withColumn("depth", F.lit(0)), {0: n})
        top = blocks.filter(F.col("level") == order[0]).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(0, self._groups(n) - 1)))))
        first = durable(self._met(groups, top, parts[order[0]], turn, d), "first-round")
        if len(order) > 1:
            # a query that has k results already needs no level whose bound is below the last of them
            kth = _ranked(first, self.k).filter(F.col("rank") == self.k).select(F.col("quid").alias("uid"), F.col("score").alias("kth"))
            asked = queries.drop("low").join(kth, "uid", "left").withColumn("low", F.coalesce("kth", F.lit(_LEAST)))
            reach = lambda k: (F.col("kth").isNull() | (F.col("norm") * float(levels[k]["top"]) * (1 + 1e-9) + 1e-6 >= F.col("kth").cast("double"))).cast("int")
            asked = durable(asked.withColumn("depth", sum((reach(k) for k in order[1:]), F.lit(0))).filter("depth > 0"), "asked")
            deep = {r["depth"]: r["n"] for r in asked.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `levels` rows
            if deep:
                groups = self._grouped(asked, deep)
                start, total = {}, 0  # where the groups begin that reach a depth
                for depth in range(1, len(order)):
                    start[order[depth]] = total
                    total += self._groups(deep.get(depth, 0))
                rest = blocks.filter(F.col("level") > order[0]).withColumn("start", _of(start)).filter(F.col("start") < total)
                rest = rest.withColumn("group", F.explode(F.sequence(F.col("start"), F.lit(total - 1)))).drop("start")
                first = first.unionByName(self._met(groups, rest, sum(parts[k] for k in order[1:]), turn, d))
        found = _ranked(first, self.k)
        return found.select("query_id", "rank", F.when(F.col("uid") >= 0, F.col("vec_id")).alias("vec_id"), "score")

    def _groups(self, n: int) -> int:
        return -(-n // self.query_rows)

    def _grouped(self, queries: DataFrame, deep: dict[int, int]) -> DataFrame:
        """Groups of queries of equal depth, numbered by depth, of about query_rows each; one row a group."""
        start, total = {}, 0
        for depth in sorted(deep):
            start[depth] = total
            total += self._groups(deep[depth])
        of = F.greatest(_of({k: self._groups(n) for k, n in deep.items()}, "depth"), F.lit(1))
        group = (_of(start, "depth") + F.pmod(F.xxhash64("uid", F.lit(1)), of)).cast("int")
        return durable(self._packed(queries.withColumn("group", group), "group"), "queries")

    def _packed(self, rows: DataFrame, *by: str) -> DataFrame:
        """Blocks of vectors, one row each."""
        low = "low" if "low" in rows.columns else F.lit(_LEAST).alias("low")
        item = F.struct("uid", F.coalesce("vec_id", F.lit(_MOST)).alias("vec_id"), low, "v")
        out = rows.groupBy(*by).agg(F.collect_list(item).alias("all"))  # about block_rows or query_rows vectors
        return out.select(*by, *(F.col(f"all.{f}").alias(f + "s") for f in ("uid", "vec_id", "low", "v")))

    def _met(self, groups: DataFrame, blocks: DataFrame, n_blocks: int, turn: np.ndarray, d: int) -> DataFrame:
        """The cells of the grid: groups (group) with blocks (group, level, number), by descending norm."""
        k, head, columns = self.k, min(self.head, d), max(1, -(-n_blocks // self.column_blocks))
        packed = ["uids", "vec_ids", "lows", "vs"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = search = ids = None

            def found():
                rows = [(int(search.uid[i]), int(ids[i]), -u, v, -s) for i, best in enumerate(search.best) for s, v, u in best]
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], ["quid", "query_id", "uid", "vec_id", "score"])

            for b in batches:
                for i in range(b.num_rows):
                    group, column, level = (b.column(j)[i].as_py() for j in range(3))
                    uid, vec_id, low = (b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (4, 5, 6))
                    v = _matrix(b.column(7)[i].values, d)
                    if level < 0:
                        if search is not None:
                            yield found()
                        cell, ids, search = (group, column), vec_id, Search(uid, v, low, turn, k, head)
                    elif cell == (group, column):
                        search.visit(uid, vec_id, v)
            if search is not None:
                yield found()

        asking = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("number"), *packed)
        asked = blocks.select("group", F.pmod("number", F.lit(columns)).cast("int").alias("column"), "level", F.col("number").cast("long").alias("number"), *packed)
        cells = asking.unionByName(asked).repartition("group", "column").sortWithinPartitions("group", "column", "level", "number")
        return cells.mapInArrow(run, _RESULT)


def _of(values: dict[int, int], column: str = "level") -> Column:
    """The value of a level (or depth), of which there are few."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col(column)) if values else F.lit(0)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row; of a query's rows in a task only k go to meet the others."""
    w = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id", F.col("uid").desc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where ``is_query`` (over vec_id) holds."""
    return TopK(k=k).search(integer_vectors(vectors, id_col=id_col, vector_col=vector_col), is_query)
