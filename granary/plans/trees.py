"""Trees by parent ids and by intervals, rollups kept up with changes, and differences of bucketed reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import compare as C
from granary.operators import hierarchy as H
from granary.operators import rollup_state as R
from granary.plans.aggregates import _ROLLUP
from granary.plans.snapshots import _CHANGE, _SIDES, _sides
from granary.registry import query
from granary.sources.bindings import FILE_ENTRIES_SQL, ORDER_TREE_SQL, file_entries, order_tree
from granary.sources.stages import new_folder, stage


@query("j13_subtree_by_ids", ORDER_TREE_SQL + ", below AS (SELECT * FROM order_tree WHERE entry_id = 106 UNION ALL SELECT t.* FROM order_tree t JOIN below b ON t.parent_entry_id = b.entry_id) SELECT entry_id, entry_kind, size_bytes FROM below")
def j13_ids(spark, sf):
    return H.subtree_by_ids(order_tree(spark, sf), 106).select("entry_id", "entry_kind", "size_bytes")


@query("u1_paths_from_ids", ORDER_TREE_SQL + ", up AS (SELECT entry_id, '' AS path, 0 AS depth FROM order_tree WHERE parent_entry_id IS NULL UNION ALL SELECT t.entry_id, CASE WHEN up.path = '' THEN display_name ELSE up.path || '/' || display_name END, depth + 1 FROM order_tree t JOIN up ON t.parent_entry_id = up.entry_id) SELECT * FROM up")
def u1_paths(spark, sf):
    return H.with_paths(order_tree(spark, sf)).select("entry_id", "path", "depth")


@query("p7_by_interval", FILE_ENTRIES_SQL + "SELECT entry_id, path, size_bytes FROM file_entries WHERE source_id = 'src0' AND path LIKE 'en/%'")
def p7_interval(spark, sf):
    files = file_entries(spark, sf).select("source_id", "path", "entry_id", "size_bytes")
    nodes = A.directories(files).unionByName(files.select("source_id", "path"))
    placed = A.nested_intervals(nodes).join(files, ["source_id", "path"], "left")
    stored = H.store_intervals(placed, new_folder(spark, "intervals"))
    return H.subtree_by_interval(stored, "src0", "en").filter(F.col("entry_id").isNotNull()).select("entry_id", "path", "size_bytes")


@query("a4_incremental_rollup", _SIDES + _ROLLUP.format(t="r"))
def a4_incremental(spark, sf):
    before, after = (stage(side.select(*R.ROW), "snapshot") for side in _sides(spark, sf))
    state = R.rollup_state(before)
    return R.rollup_view(R.apply_difference(state, R.rollup_difference(before, *R.changes(before, after))))


@query("c5_bucketed_diff", _SIDES + f"""SELECT * FROM (SELECT coalesce(r.source_id, l.source_id) AS source_id, coalesce(r.path, l.path) AS path, {_CHANGE.format("entry_id", "l.size_bytes IS DISTINCT FROM r.size_bytes")} AS change,
 l.size_bytes AS size_before, r.size_bytes AS size_after FROM l FULL JOIN r ON l.source_id = r.source_id AND l.path = r.path) WHERE change IS NOT NULL""")
def c5_bucketed(spark, sf):
    run, keys = uuid.uuid4().hex, ["source_id", "path"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reports = [C.publish_bucketed(s.select(*keys, *C.FILE_COLUMNS), f"report_{n}_{run}", keys, buckets, new_folder(spark, f"report-{n}")) for n, s in zip("lr", _sides(spark, sf))]
    return C.bucketed_diff(*reports, keys, list(C.FILE_COLUMNS)).select(*keys, "change", F.col("before.size_bytes").alias("size_before"), F.col("after.size_bytes").alias("size_after"))
