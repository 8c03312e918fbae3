"""Section rows of a report, and the full export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.expressions import export_time, strict_sum
from granary.operators import aggregates as A
from granary.operators import control as K
from granary.operators import duplicates as D
from granary.operators.rankings import ranking
from granary.plans.control import NOW, QUOTAS_SQL, quota_records
from granary.registry import query
from granary.sources import sinks
from granary.sources.bindings import FILE_ENTRIES_SQL, SAMPLES_SQL, file_contents, file_entries, table, volume_samples
from granary.sources.stages import stage

REPORT = "r1"


def _base(rows, *, bytes_kind="long", keep=(), **columns):
    """The ten fields of a section's rows; what a section does not know is null. keep: columns it is ordered by."""
    kinds = {"owner_uid": "long", "logical_size_bytes": bytes_kind, "allocated_size_estimate_bytes": bytes_kind}
    return rows.select(*(columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in sinks.BASE_FIELDS), *keep)


def named(rows, names=None):
    """rows with source_name: from a dimension (source_id, source_name), or the id where that has none."""
    if names is None:
        return rows.withColumn("source_name", F.col("source_id"))
    return rows.join(names.select("source_id", "source_name"), "source_id", "left").withColumn("source_name", F.coalesce("source_name", "source_id"))


def files_section(files, names=None, keep=()):
    return _base(
        named(files, names), report_id=F.lit(REPORT), source_name=F.col("source_name"), relative_path_display=F.col("path"), owner_uid=F.col("uid"), category=F.col("category_id"), logical_size_bytes=F.col("size_bytes"),
        allocated_size_estimate_bytes=F.col("allocated_bytes_estimate"), mtime=export_time("mtime_sec", "mtime_nsec"), atime=export_time("atime_sec", "atime_nsec"), status=F.coalesce("scan_error", F.lit("complete")), keep=keep,
    )


def ordered_sections(spark, sf, names=None):
    """Each of the ten sections: its rows (the ten fields and what orders them) and the columns of its order. The files' metadata is read once."""
    files = stage(file_entries(spark, sf), "files")
    r, known = F.lit(REPORT), {"report_id": F.lit(REPORT), "source_name": F.col("source_name")}
    out = {}
    folders = named(A.directory_rollup(files), names)
    status = F.when(F.col("logical_bytes").isNull(), "unknown").otherwise("complete")
    out["folders"] = (_base(folders, **known, relative_path_display=F.col("path"), category=F.lit("folder"), logical_size_bytes=F.col("logical_bytes"), allocated_size_estimate_bytes=F.col("allocated_bytes"), status=status, keep=("source_id", "path")), [F.col("source_id"), F.col("path")])
    owners = named(A.owner_aggregate(files), names)
    path = F.concat(F.lit("owner/"), F.coalesce(F.col("uid").cast("string"), F.lit("unknown")))
    out["owners"] = (_base(owners, **known, relative_path_display=path, owner_uid=F.col("uid"), logical_size_bytes=F.col("logical_bytes"), status=F.lit("complete"), keep=("source_id", "uid")), [F.col("source_id"), F.col("uid").asc_nulls_first()])
    categories = named(A.category_aggregate(files), names)
    out["categories"] = (_base(categories, **known, relative_path_display=F.concat(F.lit("category/"), "category_id"), category=F.col("category_id"), logical_size_bytes=F.col("logical_bytes"), allocated_size_estimate_bytes=F.col("allocated_bytes"), status=F.lit("complete"), keep=("source_id", "category_id")), [F.col("source_id"), F.col("category_id")])
    groups = D.groups(D.hashed(D.candidates(files), file_contents(spark, sf)))
    members = F.concat(F.col("member_count").cast("string"), F.lit(" members"))
    out["duplicates"] = (_base(groups, report_id=r, source_name=F.lit("duplicates"), relative_path_display=F.concat(F.lit("group/"), "sha256"), logical_size_bytes=F.col("logical_redundancy_bytes"), allocated_size_estimate_bytes=F.col("size_bytes"), status=members, keep=("logical_redundancy_bytes", "sha256")), [F.col("logical_redundancy_bytes").desc(), F.col("sha256")])
    for kind in ("largest", "recently_modified", "least_accessed"):
        out[kind] = (files_section(ranking(files, kind), names, ("rank",)), [F.col("rank")])
    volume = volume_samples(spark, sf)
    at = F.concat_ws("/", "volume_id", F.date_format("sample_time", "yyyy-MM-dd'T'HH:mm"))
    out["volume"] = (_base(volume, bytes_kind="decimal(20,0)", report_id=r, source_name=F.lit("volume"), relative_path_display=at, logical_size_bytes=F.col("used_bytes"), allocated_size_estimate_bytes=F.col("total_bytes"), status=F.col("quality"), keep=("sample_time", "volume_id")), [F.col("sample_time").desc(), F.col("volume_id")])
    quota = K.effective_quotas(quota_records(spark, sf), NOW)
    keys = ("principal_namespace", "principal_uid", "scope_kind", "scope_id")
    out["quota"] = (_base(quota, bytes_kind="decimal(20,0)", report_id=r, source_name=F.lit("quota"), relative_path_display=F.concat_ws("/", "scope_kind", "scope_id", "metric"), owner_uid=F.col("principal_uid"), allocated_size_estimate_bytes=F.col("limit_bytes"), status=F.when(F.col("stale"), "stale").otherwise(F.col("limit_state")), keep=keys), [F.col(k) for k in keys])
    out["files"] = (files_section(files, names, ("size_bytes", "entry_id")), [F.col("size_bytes").desc_nulls_last(), F.col("entry_id")])
    return out


def sections(spark, sf, names=None):
    """Each section as rows of the ten fields."""
    return {name: rows.select(*sinks.BASE_FIELDS) for name, (rows, _) in ordered_sections(spark, sf, names).items()}


def source_names(spark, sf):
    """Display names of the sources; one has none."""
    return table(spark, sf, "documents").filter("source <> 'src3'").select(F.col("source").alias("source_id"), F.concat(F.lit("Source "), "source").alias("source_name")).distinct()


@query("x1_files_section", FILE_ENTRIES_SQL + """SELECT 'r1' AS report_id, source_id AS source_name, path AS relative_path_display, uid AS owner_uid, category_id AS category, size_bytes AS logical_size_bytes, allocated_bytes_estimate AS allocated_size_estimate_bytes,
CASE WHEN mtime_sec IS NOT NULL THEN mtime_sec || '.' || lpad(mtime_nsec::VARCHAR, 9, '0') || 'Z' END AS mtime, CASE WHEN atime_sec IS NOT NULL THEN atime_sec || '.' || lpad(atime_nsec::VARCHAR, 9, '0') || 'Z' END AS atime, coalesce(scan_error, 'complete') AS status FROM file_entries""")
def x1(spark, sf):
    return files_section(file_entries(spark, sf))


@query("j12_source_names", FILE_ENTRIES_SQL + "SELECT path AS relative_path_display, CASE WHEN source_id = 'src3' THEN source_id ELSE 'Source ' || source_id END AS source_name FROM file_entries")
def j12(spark, sf):
    return files_section(file_entries(spark, sf), source_names(spark, sf)).select("relative_path_display", "source_name")


_ALL = FILE_ENTRIES_SQL.rstrip() + ", " + SAMPLES_SQL.strip().removeprefix("WITH").rstrip() + ", " + QUOTAS_SQL.strip().removeprefix("WITH").rstrip() + """,
up AS (SELECT source_id, size_bytes, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS i FROM file_entries)),
s_folders AS (SELECT source_id, path, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes) END AS b FROM up GROUP BY 1, 2),
s_owners AS (SELECT source_id, uid, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes) END AS b FROM file_entries GROUP BY 1, 2),
s_categories AS (SELECT source_id, category_id, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes) END AS b FROM file_entries GROUP BY 1, 2),
s_duplicates AS (SELECT size_bytes, sha256(content) AS sha256, (count(DISTINCT file_identity_key) - 1) * size_bytes AS b FROM file_entries WHERE size_bytes >= 1 GROUP BY 1, 2 HAVING count(DISTINCT file_identity_key) > 1),
s_quota AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY principal_namespace, principal_uid, scope_kind, scope_id, metric ORDER BY stale, observed_at DESC, CASE origin WHEN 'system_imported' THEN 0 WHEN 'advisory' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, id DESC) = 1),
listed AS (
  SELECT 'folders' AS section, path AS shown, b::DECIMAL(38, 0) AS bytes, row_number() OVER (ORDER BY source_id, path) AS place FROM s_folders UNION ALL
  SELECT 'owners', 'owner/' || coalesce(uid::VARCHAR, 'unknown'), b, row_number() OVER (ORDER BY source_id, uid NULLS FIRST) FROM s_owners UNION ALL
  SELECT 'categories', 'category/' || category_id, b, row_number() OVER (ORDER BY source_id, category_id) FROM s_categories UNION ALL
  SELECT 'duplicates', 'group/' || sha256, b, row_number() OVER (ORDER BY b DESC, sha256) FROM s_duplicates UNION ALL
  SELECT * FROM (SELECT 'largest', path, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, entry_id) AS p FROM file_entries WHERE size_bytes IS NOT NULL) WHERE p <= 200 UNION ALL
  SELECT * FROM (SELECT 'recently_modified', path, size_bytes, row_number() OVER (ORDER BY mtime_sec DESC NULLS LAST, mtime_nsec DESC NULLS LAST, entry_id) AS p FROM file_entries WHERE size_bytes IS NOT NULL) WHERE p <= 200 UNION ALL
  SELECT * FROM (SELECT 'least_accessed', path, size_bytes, row_number() OVER (ORDER BY atime_sec NULLS FIRST, atime_nsec NULLS FIRST, entry_id) AS p FROM file_entries WHERE size_bytes IS NOT NULL) WHERE p <= 200 UNION ALL
  SELECT 'volume', volume_id || '/' || strftime(sample_time, '%Y-%m-%dT%H:%M'), used_bytes, row_number() OVER (ORDER BY sample_time DESC, volume_id) FROM volume_samples UNION ALL
  SELECT 'quota', scope_kind || '/' || scope_id || '/' || metric, NULL, row_number() OVER (ORDER BY principal_namespace, principal_uid, scope_kind, scope_id) FROM s_quota UNION ALL
  SELECT 'files', path, size_bytes, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, entry_id) FROM file_entries) """


@query("x2_section_pages", _ALL + "SELECT section, place, shown FROM listed WHERE place <= 30")
def x2(spark, sf):
    """The first page of each section, in its order."""
    out = None
    for name, (rows, order) in ordered_sections(spark, sf).items():
        page = rows.orderBy(*order).limit(30)
        placed = page.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), F.col("relative_path_display").alias("shown"))
        out = placed if out is None else out.unionByName(placed)
    return out


@query("x3_full_report", _ALL + "SELECT section, count(*) AS n, sum(bytes)::DECIMAL(38, 0) AS bytes FROM listed GROUP BY 1")
def x3(spark, sf):
    rows = sinks.full_report(sections(spark, sf))
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum("logical_size_bytes").cast("decimal(38,0)").alias("bytes"))


@query("i13_csv_lines", FILE_ENTRIES_SQL + """SELECT 'r1,' || source_id || ',' || path || ',' || coalesce(uid::VARCHAR, '') || ',' || category_id || ',' || coalesce(size_bytes::VARCHAR, '') || ',' || coalesce(allocated_bytes_estimate::VARCHAR, '') || ',' ||
coalesce(mtime_sec || '.' || lpad(mtime_nsec::VARCHAR, 9, '0') || 'Z', '') || ',' || coalesce(atime_sec || '.' || lpad(atime_nsec::VARCHAR, 9, '0') || 'Z', '') || ',' || coalesce(scan_error, 'complete') || chr(13) AS value FROM file_entries""")
def i13(spark, sf):
    return sinks.csv_lines(files_section(file_entries(spark, sf)))


@query("n1_summary_rows", FILE_ENTRIES_SQL + """, c AS (SELECT category_id, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM file_entries GROUP BY 1)
SELECT 'category:' || category_id AS section, 'file_count' AS metric, n::VARCHAR AS value FROM c UNION ALL SELECT 'category:' || category_id, 'logical_bytes', coalesce(b::VARCHAR, '') FROM c""")
def n1(spark, sf):
    c = A.grouped_sizes(file_entries(spark, sf), "category_id").select(F.concat(F.lit("category:"), "category_id").alias("section"), F.col("file_count").cast("string").alias("file_count"), F.coalesce(F.col("logical_bytes").cast("string"), F.lit("")).alias("logical_bytes"))
    return c.unpivot("section", ["file_count", "logical_bytes"], "metric", "value")


@query("n1_summary_sources", _ALL + """, top AS (SELECT f.source_id, count(*) AS n, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS b FROM file_entries f GROUP BY 1)
SELECT 'source' AS section, source_id AS metric, v AS value FROM (SELECT source_id, unnest([CASE WHEN source_id = 'src3' THEN source_id ELSE 'Source ' || source_id END, 'file_count=' || n, 'logical_bytes=' || coalesce(b::VARCHAR, 'null'), 'completeness=' || CASE WHEN b IS NULL THEN 'unknown' ELSE 'complete' END]) AS v FROM top) UNION ALL
SELECT 'totals', 'file_count', count(*)::VARCHAR FROM file_entries UNION ALL SELECT 'totals', 'logical_bytes', CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT::VARCHAR ELSE 'null' END FROM file_entries UNION ALL
SELECT 'owners', 'count', count(DISTINCT coalesce(uid, -1))::VARCHAR FROM file_entries UNION ALL
SELECT 'duplicates', 'group_count', count(*)::VARCHAR FROM s_duplicates UNION ALL SELECT 'duplicates', 'logical_redundancy_bytes', sum(b)::BIGINT::VARCHAR FROM s_duplicates""")
def n1_sources(spark, sf):
    """Long form (section, metric, value): folders at depth 0, totals, owners and duplicates; nothing that names a file."""
    files = stage(file_entries(spark, sf), "files")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    top = named(A.directory_rollup(files).filter("path = ''"), source_names(spark, sf))
    lines = [F.col("source_name"), *(F.concat(F.lit(f"{m}="), shown(m)) for m in ("file_count", "logical_bytes")), F.concat(F.lit("completeness="), F.when(F.col("logical_bytes").isNull(), "unknown").otherwise("complete"))]
    sources = top.select(F.lit("source").alias("section"), F.col("source_id").alias("metric"), F.explode(F.array(*lines)).alias("value"))
    long = lambda df, section: df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in df.columns)).unpivot([], df.columns, "metric", "value").select(F.lit(section).alias("section"), "metric", "value")
    totals = files.agg(F.count(F.lit(1)).alias("file_count"), strict_sum("size_bytes").alias("logical_bytes"))
    owners = files.agg(F.count_distinct(F.coalesce("uid", F.lit(-1))).alias("count"))
    groups = D.redundancy_total(D.groups(D.hashed(D.candidates(files), file_contents(spark, sf)))).select("group_count", F.col("redundant_bytes").alias("logical_redundancy_bytes"))
    return sources.unionByName(long(totals, "totals")).unionByName(long(owners, "owners")).unionByName(long(groups, "duplicates"))
