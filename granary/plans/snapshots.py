"""Differences between two snapshots of the same files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators import compare as C
from granary.registry import query
from granary.sources.bindings import FILE_ENTRIES_SQL, file_entries, table

#: left lacks some files, right others; some sizes grew.
_SIDES = FILE_ENTRIES_SQL + """, l AS (SELECT * FROM file_entries WHERE entry_id % 11 <> 0),
r AS (SELECT * REPLACE (CASE WHEN entry_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes) FROM file_entries WHERE entry_id % 13 <> 0) """


def _sides(spark, sf):
    f = file_entries(spark, sf)
    i = F.col("entry_id")
    return f.filter(i % 11 != 0), f.filter(i % 13 != 0).withColumn("size_bytes", F.when(i % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))


_CHANGE = "CASE WHEN l.{0} IS NULL THEN 'added' WHEN r.{0} IS NULL THEN 'removed' WHEN {1} THEN 'changed' END"


@query("c5_file_diff", _SIDES + f"""SELECT * FROM (SELECT coalesce(r.source_id, l.source_id) || ':' || lower(hex(coalesce(r.path, l.path))) AS row_key, {_CHANGE.format("entry_id", "l.size_bytes IS DISTINCT FROM r.size_bytes")} AS change,
 l.size_bytes AS size_before, r.size_bytes AS size_after FROM l FULL JOIN r ON l.source_id = r.source_id AND l.path = r.path) WHERE change IS NOT NULL""")
def c5(spark, sf):
    d = C.snapshot_diff(*_sides(spark, sf), ["source_id", "path"], list(C.FILE_COLUMNS))
    return d.select(F.concat_ws(":", "source_id", F.lower(F.hex(F.col("path").cast("binary")))).alias("row_key"), "change", F.col("before.size_bytes").alias("size_before"), F.col("after.size_bytes").alias("size_after"))


_FOLDERS = """, lu AS (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS i FROM l), ru AS (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS i FROM r),
lf AS (SELECT source_id, array_to_string(string_split(path, '/')[1:i], '/') AS dir, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM lu GROUP BY 1, 2),
rf AS (SELECT source_id, array_to_string(string_split(path, '/')[1:i], '/') AS dir, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM ru GROUP BY 1, 2) """


@query("c2_folder_diff", _SIDES + _FOLDERS + f"SELECT * FROM (SELECT coalesce(r.source_id, l.source_id) AS source_id, coalesce(r.dir, l.dir) AS path, {_CHANGE.format('n', 'l.n <> r.n OR l.b IS DISTINCT FROM r.b')} AS change FROM lf l FULL JOIN rf r ON l.source_id = r.source_id AND l.dir = r.dir) WHERE change IS NOT NULL")
def c2(spark, sf):
    left, right = (A.directory_rollup(x) for x in _sides(spark, sf))
    return C.snapshot_diff(left, right, ["source_id", "path"], ["file_count", "logical_bytes"]).select("source_id", "path", "change")


@query("c3_owner_diff", _SIDES + f""", lo AS (SELECT source_id, uid, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM l GROUP BY 1, 2), ro AS (SELECT source_id, uid, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM r GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(r.source_id, l.source_id) || ':' || coalesce(coalesce(r.uid, l.uid)::VARCHAR, 'unknown') AS row_key, {_CHANGE.format('n', 'l.n <> r.n OR l.b IS DISTINCT FROM r.b')} AS change, (r.n - l.n)::DECIMAL(38, 0) AS delta_file_count, (r.b::DECIMAL(38, 0) - l.b)::DECIMAL(38, 0) AS delta_logical_bytes
FROM lo l FULL JOIN ro r ON l.source_id = r.source_id AND l.uid IS NOT DISTINCT FROM r.uid) WHERE change IS NOT NULL""")
def c3(spark, sf):
    left, right = (A.owner_aggregate(x) for x in _sides(spark, sf))
    d = C.snapshot_diff(left, right, ["source_id", "uid"], ["file_count", "logical_bytes"], deltas=["file_count", "logical_bytes"])
    return d.select(C.row_key("owners").alias("row_key"), "change", F.col("delta_file_count").cast("decimal(38,0)").alias("delta_file_count"), F.col("delta_logical_bytes").cast("decimal(38,0)").alias("delta_logical_bytes"))


_CATEGORIES = """, lc AS (SELECT source_id, category_id, count(*) AS n FROM l GROUP BY 1, 2), rc AS (SELECT source_id, category_id, count(*) AS n FROM r GROUP BY 1, 2) """


@query("c4_category_diff", _SIDES + _CATEGORIES + f"SELECT * FROM (SELECT coalesce(r.source_id, l.source_id) || ':' || coalesce(r.category_id, l.category_id) AS row_key, {_CHANGE.format('n', 'l.n <> r.n')} AS change, (r.n - l.n)::DECIMAL(38, 0) AS delta FROM lc l FULL JOIN rc r ON l.source_id = r.source_id AND l.category_id = r.category_id) WHERE change IS NOT NULL")
def c4(spark, sf):
    left, right = (A.grouped_sizes(x, "source_id", "category_id") for x in _sides(spark, sf))
    d = C.snapshot_diff(left, right, ["source_id", "category_id"], ["file_count"], deltas=["file_count"])
    return d.select(C.row_key("categories").alias("row_key"), "change", F.col("delta_file_count").cast("decimal(38,0)").alias("delta"))


@query("a19_change_counts", _SIDES + f"""SELECT 'files' AS section, change, count(*) AS n FROM (SELECT {_CHANGE.format("entry_id", "l.size_bytes IS DISTINCT FROM r.size_bytes")} AS change FROM l FULL JOIN r ON l.source_id = r.source_id AND l.path = r.path) WHERE change IS NOT NULL GROUP BY 1, 2""")
def a19(spark, sf):
    return C.change_counts({"files": C.snapshot_diff(*_sides(spark, sf), ["source_id", "path"], list(C.FILE_COLUMNS))})


@query("s11_comparison_page", _SIDES + _FOLDERS + f""", lo AS (SELECT source_id, uid, count(*) AS n FROM l GROUP BY 1, 2), ro AS (SELECT source_id, uid, count(*) AS n FROM r GROUP BY 1, 2),
lc AS (SELECT source_id, category_id, count(*) AS n FROM l GROUP BY 1, 2), rc AS (SELECT source_id, category_id, count(*) AS n FROM r GROUP BY 1, 2),
d AS (SELECT 'categories' AS section, coalesce(r.source_id, l.source_id) || ':' || coalesce(r.category_id, l.category_id) AS row_key, {_CHANGE.format("n", "l.n <> r.n")} AS change FROM lc l FULL JOIN rc r ON l.source_id = r.source_id AND l.category_id = r.category_id
UNION ALL SELECT 'files', coalesce(r.source_id, l.source_id) || ':' || lower(hex(coalesce(r.path, l.path))), {_CHANGE.format("entry_id", "l.size_bytes IS DISTINCT FROM r.size_bytes")} FROM l FULL JOIN r ON l.source_id = r.source_id AND l.path = r.path
UNION ALL SELECT 'folders', coalesce(r.source_id, l.source_id) || ':' || lower(hex(coalesce(r.dir, l.dir))), {_CHANGE.format("n", "l.n <> r.n OR l.b IS DISTINCT FROM r.b")} FROM lf l FULL JOIN rf r ON l.source_id = r.source_id AND l.dir = r.dir
UNION ALL SELECT 'owners', coalesce(r.source_id, l.source_id) || ':' || coalesce(coalesce(r.uid, l.uid)::VARCHAR, 'unknown'), {_CHANGE.format("n", "l.n <> r.n")} FROM lo l FULL JOIN ro r ON l.source_id = r.source_id AND l.uid IS NOT DISTINCT FROM r.uid)
SELECT section, row_key, change FROM d WHERE change IS NOT NULL AND (section > 'categories' OR row_key > 'src1') ORDER BY section, row_key LIMIT 200""")
def s11(spark, sf):
    left, right = _sides(spark, sf)
    of = lambda f, keys, values: C.snapshot_diff(f(left), f(right), keys, values)
    diffs = {
        "categories": of(lambda x: A.grouped_sizes(x, "source_id", "category_id"), ["source_id", "category_id"], ["file_count"]), "files": of(lambda x: x, ["source_id", "path"], ["size_bytes"]),
        "folders": of(A.directory_rollup, ["source_id", "path"], ["file_count", "logical_bytes"]), "owners": of(A.owner_aggregate, ["source_id", "uid"], ["file_count"]),
    }
    return C.comparison_page(C.comparison_rows(diffs), 200, after=("categories", "src1"))


#: Reports from orders; a customer's order and the next are a pair.
@query("c1_comparable", """WITH r AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 2 AS profile_id, o_orderpriority AS scope_fingerprint, o_orderkey % 3 = 0 AS classification_version, o_orderstatus, lead(o_orderkey) OVER w AS next_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.o_orderstatus = 'P' OR r.o_orderstatus = 'P' AS failed, list_filter([CASE WHEN l.profile_id <> r.profile_id THEN 'different_profile' END, CASE WHEN l.scope_fingerprint <> r.scope_fingerprint THEN 'scope_fingerprint_mismatch' END,
  CASE WHEN l.classification_version <> r.classification_version THEN 'classification_version_mismatch' END, CASE WHEN l.o_orderstatus = 'O' OR r.o_orderstatus = 'O' THEN 'partial_report' END], lambda x: x IS NOT NULL) AS reasons FROM r l JOIN r ON l.next_id = r.id)
SELECT left_id, right_id, CASE WHEN failed THEN '' ELSE array_to_string(reasons, ',') END AS reasons, NOT failed AND len(reasons) = 0 AS comparable FROM p""")
def c1(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    one = F.struct(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("profile_id"), F.col("o_orderpriority").alias("scope_fingerprint"), (F.col("o_orderkey") % 3 == 0).alias("classification_version"),
        F.lit("same").alias("source_identities"), status.alias("status"),
    )
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", one.alias("left")).withColumn("right", F.lead("left").over(w)).filter(F.col("right").isNotNull())
    return C.comparability(pairs).select(F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id"), F.array_join("reasons", ",").alias("reasons"), "comparable")
