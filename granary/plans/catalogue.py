"""Entry tables and source observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import aggregates as A
from granary.operators.capacity import unattributed_sources
from granary.operators.rules import keep_kinds
from granary.registry import query
from granary.sources.bindings import FILE_ENTRIES_SQL, file_entries, table

_OBSERVED = FILE_ENTRIES_SQL + """, o AS (SELECT source_id, source_id <> 'src5' AS available, count(*) FILTER (scan_error IS NOT NULL) AS error_count FROM file_entries GROUP BY 1, 2),
s AS (SELECT source_id, CASE WHEN NOT available THEN 'unavailable' WHEN error_count > 0 THEN 'partial' ELSE 'complete' END AS status FROM o) """


def observations(spark, sf):
    o = file_entries(spark, sf).groupBy("source_id", (F.col("source_id") != "src5").alias("available")).agg(F.count_if(F.col("scan_error").isNotNull()).alias("error_count"))
    return A.observation_status(o.select("*", F.lit(0).alias("vanished_count"), F.lit(False).alias("cancelled")))


@query("i9_source_status", _OBSERVED + "SELECT source_id, status FROM s")
def i9(spark, sf):
    return observations(spark, sf)


@query("i10_run_status", _OBSERVED + "SELECT CASE WHEN bool_and(status = 'unavailable') THEN 'failed' WHEN bool_or(status <> 'complete') THEN 'partial' ELSE 'complete' END AS run_status FROM s")
def i10(spark, sf):
    return A.run_status(observations(spark, sf))


@query("a20_section_quality", _OBSERVED + "SELECT CASE WHEN bool_and(status = 'unavailable') THEN 'unavailable' WHEN bool_or(status <> 'complete') THEN 'partial' ELSE 'complete' END AS quality FROM s")
def a20(spark, sf):
    return A.section_quality(observations(spark, sf))


@query("r1_folder_completeness", _OBSERVED + """, up AS (SELECT source_id, size_bytes, allocated_bytes_estimate, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS i FROM file_entries))
SELECT source_id, path, CASE WHEN bool_or(size_bytes IS NULL OR allocated_bytes_estimate IS NULL) THEN 'unknown' ELSE any_value(status) END AS completeness FROM up JOIN s USING (source_id) GROUP BY 1, 2""")
def r1(spark, sf):
    return A.folder_snapshot(A.directory_rollup(file_entries(spark, sf)), observations(spark, sf)).select("source_id", "path", "completeness")


@query("i4_error_rows", FILE_ENTRIES_SQL + "SELECT entry_id, scan_error FROM file_entries WHERE scan_error IS NOT NULL AND size_bytes IS NULL AND file_identity_key IS NULL")
def i4(spark, sf):
    return file_entries(spark, sf).filter("scan_error IS NOT NULL AND size_bytes IS NULL AND file_identity_key IS NULL").select("entry_id", "scan_error")


@query("i5_kind_filter", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'regular_file' WHEN page_id % 3 = 1 THEN 'directory' ELSE 'symlink' END AS entry_kind, CASE WHEN page_id % 3 = 0 THEN strlen(html) END AS size_bytes FROM pages")
def i5(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "regular_file").when(F.col("page_id") % 3 == 1, "directory").otherwise("symlink")
    return keep_kinds(table(spark, sf, "pages").select("page_id", kind.alias("entry_kind"), F.octet_length("html").cast("long").alias("size_bytes")), "all_metadata")


@query("i6_distinct_entries", "SELECT r_name AS source_id, count(DISTINCT n_name || '/' || c_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def i6(spark, sf):
    from granary.functions.expressions import parent

    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.select(F.col("r_name").alias("source_id"), F.concat_ws("/", "n_name", "c_name", F.lit("x")).alias("path"))
    return rows.select("source_id", parent("path").alias("path")).dropDuplicates(["source_id", "path"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("j16_unattributed", "SELECT count(*) AS unattributed FROM supplier WHERE s_nationkey IS NULL OR s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j16(spark, sf):
    confirmed = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("volume_id"))
    return unattributed_sources(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("volume_id")), confirmed)


@query("r2_owner_list", FILE_ENTRIES_SQL + "SELECT source_id, uid, count(*) AS file_count FROM file_entries WHERE uid IN (1, 7, 9) GROUP BY 1, 2")
def r2(spark, sf):
    return A.owner_aggregate(file_entries(spark, sf)).filter(F.col("uid").isin(1, 7, 9)).select("source_id", "uid", "file_count")
