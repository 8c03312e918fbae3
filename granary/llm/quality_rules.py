"""Quality rules: statistics of each text, two base rules, and an isolation forest over the statistics.

Base rules reject a text of fewer than ``min_words`` words, or one in which more than
``max_repeat_percent`` percent of the words stand in 3-word windows found twice or more. Texts that
pass are scored by an isolation forest over rates of marks, symbols, capitals and word lengths: trees of
random splits, each grown on ``psi`` rows; a text that random splits part from the others after few
steps is anomalous. The score is ``2 ** (-mean path / expected path)``, kept in steps of 1/4096.

The threshold is calibrated on all labelled rows that pass the base rules, good and bad: of the steps that
lose at most ``max_good_loss`` of those labelled good it is the one that catches most of those labelled
bad, and of equals the one that loses least. What scores above it is rejected.

Each tree has a sample of its own, drawn from all rows that pass: the ``psi`` rows with the least hash of
(row, tree). Isolation forests are made of small samples by definition; ``psi`` and ``n_trees`` are
parameters. Rows are hashed where they lie, only about ``4 * psi`` a tree are moved, and trees grow in
tasks. Statistics, scores and the threshold cover all rows. The forest is the only thing broadcast, and
its size depends on the parameters alone.

Defined cases: a null text has no words and fails the base rules; texts of any length are read whole;
repeated rows give repeated results, and rows equal in doc_id and statistics count once when trees draw
their samples; an empty table gives an empty result; a doc_id labelled both ways counts for both; with no
labelled row that passes the threshold is ``default_threshold``; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import SPACES, arrow_map, durable, texts, utf8

STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_bare_words", "n_symbol_ends", "n_capitals")
STAT_SCHEMA = ", ".join(f"{c} long" for c in STAT_COLUMNS)
#: Counted as symbols: a fixed value of the statistics' definition.
SYMBOLS = b"#*$%&|<>"
#: Steps of the anomaly score.
STEPS = 4096


def _kinds() -> bytes:
    """Of each byte: a space, a symbol (s), another mark (m), a capital (A) or what words are made of (a)."""
    out = bytearray(b"a" * 256)
    for b in range(128):
        c = chr(b)
        out[b] = ord(" " if b in SPACES else "s" if b in SYMBOLS else "A" if c.isupper() else "a" if c.isalnum() or b < 33 or b == 127 else "m")
    return bytes(out)


_KINDS = _kinds()


def rule_statistics(raw: bytes) -> tuple[int, ...]:
    """The values of STAT_COLUMNS for a text's UTF-8 bytes.

    The last four: ASCII marks of any kind; words of marks alone; words that end with a symbol; words that begin with A-Z.
    """
    words = raw.split()
    solid = raw.translate(None, SPACES)
    word_chars = len(solid.decode("utf-8", "replace"))
    kinds = b" " + raw.translate(_KINDS) + b" "
    n_symbols = kinds.count(b"s")
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = 0  # words of the current run of repeated windows still to count
        for w in windows:
            if times[w] > 1:
                repeated += 3 - inside
                inside = 3
            inside = max(0, inside - 1)
    bare = len(words) - len(kinds.translate(None, b"sm").split())
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, n_symbols + kinds.count(b"m"), bare, kinds.count(b"s "), kinds.count(b" A")


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STAT_COLUMNS of every row; one pass, no shuffle."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [rule_statistics(x) for x in utf8(b.column(1))]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in zip(*rows))], ["doc_id", *STAT_COLUMNS])

        return run

    return arrow_map(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id long, {STAT_SCHEMA}")


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_bare_words, n_symbol_ends, n_capitals) -> np.ndarray:
    """Rows of rates that do not depend on a text's length: characters a word, symbols and marks a character, and shares of words."""
    n = np.maximum(np.asarray(n_words, float), 1)
    chars = np.maximum(np.asarray(word_chars, float), 1)
    of = lambda x, y: np.asarray(x, float) / y
    return np.column_stack([chars / n, of(n_symbols, chars), of(n_marks, chars), of(n_bare_words, n), of(n_symbol_ends, n), of(n_capitals, n)])


def _expected_path(n: int) -> float:
    """The mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_tree(x: np.ndarray, psi: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the rows of x: of each node the column of its split (-1: leaf), the value, and a leaf's path length."""
    depth = max(1, math.ceil(math.log2(max(2, psi))))
    nodes = 2 ** (depth + 1) - 1
    column, value, path = np.full(nodes, -1, np.int64), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, x)]
    while todo:
        node, level, rows = todo.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.nonzero(high > low)[0]
        if level == depth or len(rows) < 2 or not len(wide):
            path[node] = level + _expected_path(len(rows))
            continue
        c = int(rng.choice(wide))
        v = rng.uniform(low[c], high[c])
        column[node], value[node] = c, v
        todo += [(2 * node + 1, level + 1, rows[rows[:, c] < v]), (2 * node + 2, level + 1, rows[rows[:, c] >= v])]
    return column, value, path


@dataclass
class IsolationForest:
    """Trees as arrays, one row a tree."""

    column: np.ndarray
    value: np.ndarray
    path: np.ndarray
    psi: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Steps of 1/4096: higher is more anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, path in zip(self.column, self.value, self.path):
            node = np.zeros(len(x), np.int64)
            while True:
                c = column[node]
                inner = c >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(c, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        mean = total / max(1, len(self.column))
        return np.floor(np.exp2(-mean / max(_expected_path(self.psi), 1e-9)) * STEPS).astype(np.int64)


def calibrated(steps: list[tuple[int, int, int]], max_good_loss: float) -> int | None:
    """The threshold from (step, good rows, bad rows): rows above it are rejected. None without rows."""
    good, bad = sum(g for _, g, _ in steps), sum(b for _, _, b in steps)
    best, lost, caught = None, 0, 0
    for step, g, b in sorted(steps, reverse=True):  # what would be lost and caught with this step as the threshold
        if lost > max_good_loss * good:
            break
        if best is None or (caught, -lost) > best[:2]:
            best = (caught, -lost, step)
        lost, caught = lost + g, caught + b
    if steps and lost <= max_good_loss * good and (caught, -lost) > best[:2]:  # even the least anomalous may go
        best = (caught, -lost, min(steps)[0] - 1)
    return best[2] if good + bad else None


@dataclass
class QualityRules:
    """Base rules, forest and threshold; ``fit`` learns the latter two."""

    min_words: int = 50
    max_repeat_percent: int = 50
    n_trees: int = 100
    psi: int = 256
    max_good_loss: float = 0.005
    default_threshold: float = 0.75
    seed: int = 7
    forest: IsolationForest | None = None
    threshold: int = 0

    def base_failed(self):
        return (F.col("n_words") < self.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(self.max_repeat_percent) * F.col("n_words"))

    def samples(self, passed: DataFrame) -> DataFrame:
        """tree, pick and STAT_COLUMNS: the rows each tree is grown on, psi at most."""
        row = F.xxhash64("doc_id", *STAT_COLUMNS)
        n = passed.agg(F.approx_count_distinct(row).alias("n")).first()["n"]
        # about 4 * psi rows a tree pass this cut, so that psi are left for certain; all rows of a small table
        cut = (1 << 63) - 1 if n <= 8 * self.psi else int(4 * self.psi / n * (1 << 63))
        hashed = F.transform(F.sequence(F.lit(0), F.lit(self.n_trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.col("row"), t + self.seed * 1000).bitwiseAND((1 << 63) - 1).alias("pick")))
        drawn = passed.withColumn("row", row).select(F.explode(F.filter(hashed, lambda x: x["pick"] <= cut)).alias("x"), *STAT_COLUMNS)
        w = Window.partitionBy("tree").orderBy("pick")  # a tree has a few times psi rows
        return drawn.select("x.*", *STAT_COLUMNS).dropDuplicates(["tree", "pick"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= self.psi).drop("place")

    def fit(self, statistics: DataFrame, labels: DataFrame) -> QualityRules:
        """statistics: of all rows, as a durable table. labels: doc_id, quality (0 or 1), those to calibrate on."""
        passed = statistics.filter(~self.base_failed())
        psi, seed = self.psi, self.seed

        def grow(rows):
            import pandas as pd

            rows = rows.sort_values("pick")
            tree = int(rows["tree"].iloc[0])
            column, value, path = grow_tree(features(*(rows[c].to_numpy() for c in STAT_COLUMNS)), psi, np.random.default_rng([seed, tree]))
            return pd.DataFrame({"tree": [tree], "n": [len(rows)], "column": [column.tolist()], "value": [value.tolist()], "path": [path.tolist()]})

        trees = sorted(self.samples(passed).groupBy("tree").applyInPandas(grow, "tree int, n int, column array<long>, value array<double>, path array<double>").collect())  # n_trees rows
        arrays = [np.array([r[c] for r in trees]) for c in ("column", "value", "path")]
        self.forest = IsolationForest(*arrays, max([2, *(r["n"] for r in trees)]))
        known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
        counts = self._scored(passed.join(known, "doc_id"), "quality int").groupBy("step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        found = calibrated([tuple(r) for r in counts.collect()], self.max_good_loss)  # at most STEPS + 1 rows
        self.threshold = math.floor(self.default_threshold * STEPS) if found is None else found
        return self

    def _scored(self, statistics: DataFrame, *more: str) -> DataFrame:
        forest = self.forest

        def make():
            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                x = features(*(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in STAT_COLUMNS))
                return pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.scores(x), pa.int64())], [*b.schema.names, "step"])

            return run

        return arrow_map(statistics.select("doc_id", *STAT_COLUMNS, *(m.split()[0] for m in more)), make, ", ".join(["doc_id long", STAT_SCHEMA, *more, "step long"]))

    def judge(self, statistics: DataFrame) -> DataFrame:
        """statistics with base_failed, anomaly (0 to 1) and kept."""
        return self._scored(statistics).select(
            "doc_id", *STAT_COLUMNS, self.base_failed().alias("base_failed"), (F.col("step") / STEPS).alias("anomaly"),
            (~self.base_failed() & (F.col("step") <= self.threshold)).alias("kept"),
        )

    def keep(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """The rows of docs that are kept, with all their columns: judged where they lie, without a shuffle."""
        forest, threshold, least, percent = self.forest, self.threshold, self.min_words, self.max_repeat_percent

        @F.pandas_udf("boolean")
        def kept(text):
            import pandas as pd

            s = np.array([rule_statistics((t or "").encode()) for t in text], np.int64).reshape(-1, len(STAT_COLUMNS))
            step = forest.scores(features(*s.T))
            return pd.Series((s[:, 0] >= least) & (100 * s[:, 4] <= percent * s[:, 0]) & (step <= threshold))

        return docs.filter(kept(F.col(text_col)))


def fit_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, **parameters) -> tuple[QualityRules, DataFrame]:
    """The fitted rules and the durable statistics they were fitted on."""
    statistics = durable(text_statistics(docs), "rule-statistics")
    return QualityRules(**parameters).fit(statistics, labels), statistics
