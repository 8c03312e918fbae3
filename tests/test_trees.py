"""Trees by ids and intervals, kept rollups, bucketed differences: against brute force, and by their plans."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import compare as C
from granary.operators import hierarchy as H
from granary.operators import rollup_state as R

ENTRY = "entry_id long, parent_entry_id long, entry_kind string, display_name string"


def brute_path(rows, i):
    by_id, names, seen = {r[0]: r for r in rows}, [], set()
    while True:
        if i not in by_id or i in seen:
            return None
        seen.add(i)
        _, up, _, name = by_id[i]
        if up is None:
            return "/".join(reversed(names))
        names.append(name)
        i = up


def random_tree(rng, n):
    rows = [(1, None, "directory", "top"), (2, None, "directory", "other")]
    folders = [1, 2]
    for i in range(3, n):
        up = rng.choice(folders[-4:] if rng.random() < 0.5 else folders)
        kind = "directory" if rng.random() < 0.4 else "regular_file"
        rows.append((i, up, kind, f"n{i}"))
        if kind == "directory":
            folders.append(i)
    return rows


@pytest.mark.parametrize("seed", range(1))
def test_paths_and_subtrees(spark, seed):
    rng = random.Random(seed)
    rows = random_tree(rng, 150)
    rows += [(900, 901, "directory", "x"), (901, 902, "directory", "y"), (902, 900, "directory", "z"), (903, 900, "regular_file", "in a circle"), (910, 999, "directory", "dangling"), (911, 910, "regular_file", "below it")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ENTRY)
    got = {r["entry_id"]: (r["path"], r["depth"]) for r in H.with_paths(df).collect()}
    want = {r[0]: brute_path(rows, r[0]) for r in rows}
    assert got == {i: (p, None if p is None else len(p.split("/")) if p else 0) for i, p in want.items()}
    folders = [r[0] for r in rows if r[2] == "directory" and r[0] < 900]
    for target in [1, *rng.sample(folders, 2)]:
        below = {r["entry_id"] for r in H.subtree_by_ids(df, target).collect()}
        up = {r[0]: r[1] for r in rows}

        def inside(i):
            seen = set()
            while i is not None and i not in seen:
                if i == target:
                    return True
                seen.add(i)
                i = up.get(i)
            return False

        assert below == {r[0] for r in rows if inside(r[0])}
    with pytest.raises(ValueError):
        H.subtree_by_ids(df, 911)


def test_rounds_grow_as_the_logarithm_of_the_depth(spark):
    rows = [(i, i - 1 or None, "directory", "d") for i in range(1, 601)]
    df = spark.createDataFrame(rows, ENTRY)
    state, rounds = H._doubled(df.select(F.col("entry_id").alias("id"), F.col("parent_entry_id").alias("up"), F.lit(1).alias("n")), {"n": lambda own, above: own + F.coalesce(above, F.lit(0))}, F.col("up").isNull())
    assert rounds == 10 and state.agg(F.max("n")).first()[0] == 600


def test_a_subtree_is_a_range_that_the_scan_uses(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    files = spark.createDataFrame([("s" if k % 3 else "t", f"d{k % 7}/e{k % 11}/f{k}", k) for k in range(500)], "source_id string, path string, entry_id long")
    placed = A.nested_intervals(A.directories(files).unionByName(files.select("source_id", "path"))).join(files, ["source_id", "path"], "left")
    stored = H.store_intervals(placed, str(tmp_path / "tree"))
    got = H.subtree_by_interval(stored, "s", "d3/e5")
    assert {r["path"] for r in got.collect()} == {"d3/e5", *(f"d{k % 7}/e{k % 11}/f{k}" for k in range(500) if k % 3 and k % 7 == 3 and k % 11 == 5)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(dfs_left" in pushed and "LessThanOrEqual(dfs_left" in pushed and "EqualTo(source_id" in pushed
    with pytest.raises(ValueError):
        H.subtree_by_interval(stored, "s", "nowhere")


def test_files_are_in_ranges(spark, tmp_path):
    """Each file of the stored table holds a stretch that no other overlaps."""
    nodes = spark.range(1000).select(F.lit("s").alias("source_id"), F.col("id").cast("string").alias("path"), F.col("id").alias("dfs_left"), F.col("id").alias("dfs_right"))
    stored = H.store_intervals(nodes, str(tmp_path / "t"))
    spans = sorted((r["a"], r["z"]) for r in stored.groupBy(F.input_file_name()).agg(F.min("dfs_left").alias("a"), F.max("dfs_left").alias("z")).collect())
    assert all(z < a for (_, z), (a, _) in zip(spans, spans[1:]))


FILE = "entry_id long, source_id string, path string, size_bytes long, allocated_bytes_estimate long, file_identity_key string"


@pytest.mark.parametrize("seed", range(2))
def test_a_kept_rollup_equals_a_new_one(spark, seed):
    """Files added, removed, moved and changed; links whose first name goes; unknown values that come and heal; folders born and emptied."""
    rng = random.Random(seed)

    def file(i):
        return (i, rng.choice("st"), "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))).strip("/") + f"/f{i}", rng.choice([None, 0, 5, 70]), rng.choice([None, 64]), rng.choice([None, f"k{rng.randrange(25)}", f"k{rng.randrange(25)}"]))

    def clean(rows):
        return [(i, s, p.lstrip("/"), *rest) for i, s, p, *rest in rows]

    before = clean(file(i) for i in range(80))
    after = [r for r in before if rng.random() > 0.2]
    after = clean([file(r[0]) if rng.random() < 0.2 else r for r in after] + [file(i) for i in range(200, 215)])
    frames = [spark.createDataFrame(x, FILE) for x in (before, after)]
    state = R.rollup_state(frames[0])
    columns = ["source_id", "path", "file_count", "logical_bytes", "unique_bytes", "allocated_bytes", "dir_count"]

    def rows(df):
        return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))

    assert rows(R.rollup_view(state)) == rows(A.directory_rollup(frames[0]))
    kept = R.apply_difference(state, R.rollup_difference(frames[0], *R.changes(*frames)))
    assert rows(R.rollup_view(kept)) == rows(A.directory_rollup(frames[1]))
    nothing = R.apply_difference(kept, R.rollup_difference(frames[1], *R.changes(frames[1], frames[1])))
    assert rows(R.rollup_view(nothing)) == rows(A.directory_rollup(frames[1]))


def test_bucketed_reports_meet_without_an_exchange(spark, tmp_path):
    left = spark.createDataFrame([("s", f"p{k}", k) for k in range(300)], "source_id string, path string, size_bytes long")
    right = spark.createDataFrame([("s", f"p{k}", k + (k % 9 == 0)) for k in range(20, 330)], "source_id string, path string, size_bytes long")
    keys = ["source_id", "path"]
    a, b = (C.publish_bucketed(df, f"bucketed_{n}", keys, 4, str(tmp_path / n)) for n, df in (("l", left), ("r", right)))
    got = C.bucketed_diff(a, b, keys, ["size_bytes"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = C.snapshot_diff(left, right, keys, ["size_bytes"])
    of = lambda df: sorted((r["path"], r["change"], r["before"] and r["before"]["size_bytes"], r["after"] and r["after"]["size_bytes"]) for r in df.collect())
    assert of(got) == of(want) and {r[1] for r in of(got)} == {"added", "removed", "changed"}
    spark.sql("DROP TABLE bucketed_l")
    spark.sql("DROP TABLE bucketed_r")
