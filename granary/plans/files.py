"""File queries: filters, sorts, subtrees, rules, classification and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import expressions as X
from granary.operators import file_query as Q
from granary.functions.categories import DEFAULT_RULESET
from granary.operators.aggregates import directories, directory_rollup, grouped_sizes
from granary.operators.pages import StoredOrder
from granary.operators.ranges import sum_before
from granary.operators.rankings import ranking
from granary.operators.rules import PathRules, excluded_by_directory
from granary.registry import query
from granary.sources.bindings import FILE_ENTRIES_SQL, ORDER_ENTRIES_SQL, file_entries, order_entries, table
from granary.sources.stages import new_folder


def select(name, where, spec, columns="entry_id, size_bytes"):
    @query(name, FILE_ENTRIES_SQL + f"SELECT {columns} FROM file_entries WHERE {where}")
    def run(spark, sf):
        return Q.find(file_entries(spark, sf), spec).select(*(c.strip() for c in columns.split(",")))


select("p1_file_detail", "true", Q.QuerySpec(), "entry_id, source_id, path, display_name, file_identity_key, nlink, uid, size_bytes, allocated_bytes_estimate, mtime_sec, mtime_nsec, atime_sec, atime_nsec, category_id, extension, scan_error")
select("p2_set_membership", "source_id IN ('src0', 'src3') AND category_id IN ('documents', 'other') AND uid IN (1, 2, 3, 4, 5, 6, 7, 8)", Q.QuerySpec(source_ids=("src3", "src0"), category_ids=("documents", "other"), owner_uids=tuple(range(1, 9))))
select("p2_extensions", "extension IN ('tar.gz', 'jpg')", Q.QuerySpec(extensions=("TAR.GZ", "jpg")))
select("p3_substring", "contains(display_name, '1.t')", Q.QuerySpec(name_contains="1.t"))
select("p4_size_range", "size_bytes BETWEEN 500 AND 2000", Q.QuerySpec(min_size_bytes="0500", max_size_bytes="2000"))
select("p5_time_range", "(mtime_sec > 1610000000 OR mtime_sec = 1610000000 AND mtime_nsec >= 0) AND mtime_sec < 1640000000", Q.QuerySpec(mtime_from="2021-01-07T06:13:20Z", mtime_to="2021-12-20T11:33:20Z"))
select("p7_subtree", "source_id = 'src0' AND starts_with(path, 'en/')", Q.QuerySpec(source_ids=("src0",), directory="en"))
select("p9_combined", "source_id = 'src0' AND size_bytes >= 100 AND contains(display_name, '.') AND atime_sec < 1680000000", Q.QuerySpec(source_ids=("src0",), min_size_bytes="100", name_contains=".", atime_to="2023-03-28T10:40:00Z"))


@query("p6_direct_children", FILE_ENTRIES_SQL + "SELECT entry_id FROM file_entries WHERE source_id = 'src0' AND regexp_matches(path, '^en/d1/[^/]*$')")
def p6(spark, sf):
    return Q.direct_children(file_entries(spark, sf), "src0", "en/d1").select("entry_id")


@query("p8_directory_exists", FILE_ENTRIES_SQL + "SELECT d, EXISTS (SELECT 1 FROM file_entries WHERE source_id = 'src0' AND starts_with(path, d || '/')) AS is_directory FROM (VALUES ('en'), ('en/d1'), ('xx')) t(d)")
def p8(spark, sf):
    asked = spark.createDataFrame([("en",), ("en/d1",), ("xx",)], "d string")
    known = directories(file_entries(spark, sf)).filter("source_id = 'src0'").select(F.col("path").alias("d"), F.lit(True).alias("k"))
    return asked.join(known, "d", "left").select("d", F.coalesce("k", F.lit(False)).alias("is_directory"))


@query("p10_null_safe_owner", FILE_ENTRIES_SQL + "SELECT entry_id FROM file_entries WHERE uid IS NOT DISTINCT FROM NULL")
def p10(spark, sf):
    return file_entries(spark, sf).filter(F.col("uid").eqNullSafe(F.lit(None).cast("long"))).select("entry_id")


RULES = PathRules(exclude=("**/d1/*.bin", "*.mp4"), include=("*.txt", "*.gz", "en/**"))
_REASON = """CASE WHEN regexp_matches(path, '(^|/)\\.') THEN 'hidden' WHEN regexp_matches(path, '^(.*/)?d1/[^/]*\\.bin$') OR regexp_matches(path, '(^|/)[^/]*\\.mp4$') THEN 'exclude_glob'
  WHEN NOT (regexp_matches(path, '\\.txt$') OR regexp_matches(path, '\\.gz$') OR starts_with(path, 'en/')) THEN 'not_included' END"""


@query("p16_rules", FILE_ENTRIES_SQL + f"SELECT entry_id, {_REASON} AS excluded_reason FROM file_entries")
def p16(spark, sf):
    return file_entries(spark, sf).select("entry_id", RULES.reason("path", F.lit(False)).alias("excluded_reason"))


@query("p17_excluded_counts", FILE_ENTRIES_SQL + f"SELECT source_id, regexp_replace(path, '/[^/]*$', '') AS path, count(*) AS excluded_count FROM file_entries WHERE {_REASON} IS NOT NULL GROUP BY 1, 2")
def p17(spark, sf):
    return excluded_by_directory(RULES.split(file_entries(spark, sf), F.lit(False))[1])


@query("p17_excluded_rollup", FILE_ENTRIES_SQL + f""", e AS (SELECT source_id, string_split(path, '/') AS p FROM file_entries WHERE {_REASON} IS NOT NULL), k AS (SELECT source_id, string_split(path, '/') AS p FROM file_entries WHERE {_REASON} IS NULL),
up AS (SELECT source_id, array_to_string(p[1:i], '/') AS path, count(*) AS n FROM (SELECT *, unnest(range(0, len(p))) AS i FROM e) GROUP BY 1, 2), d AS (SELECT source_id, array_to_string(p[1:i], '/') AS path, count(*) AS file_count FROM (SELECT *, unnest(range(0, len(p))) AS i FROM k) GROUP BY 1, 2)
SELECT source_id, path, file_count, coalesce(n, 0)::BIGINT AS excluded_count FROM d LEFT JOIN up USING (source_id, path)""")
def p17_rollup(spark, sf):
    kept, out = RULES.split(file_entries(spark, sf), F.lit(False))
    return directory_rollup(kept, out).select("source_id", "path", "file_count", "excluded_count")


@query("f1_classification", FILE_ENTRIES_SQL + "SELECT category_id, extension, count(*) AS n FROM file_entries GROUP BY 1, 2")
def f1(spark, sf):
    return file_entries(spark, sf).groupBy("category_id", "extension").agg(F.count(F.lit(1)).alias("n"))


@query("f5_depth", FILE_ENTRIES_SQL + "SELECT len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, count(*) AS n FROM file_entries GROUP BY 1")
def f5(spark, sf):
    return file_entries(spark, sf).groupBy(X.depth("path").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("f9_raw_keys", FILE_ENTRIES_SQL + "SELECT entry_id, lower(hex(path)) AS raw_key FROM file_entries")
def f9(spark, sf):
    return file_entries(spark, sf).select("entry_id", X.raw_key(F.col("path").cast("binary")).alias("raw_key"))


@query("f11_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_sha256("text").alias("sha256"))


@query("f19_csv_safe", "SELECT doc_id, CASE WHEN regexp_matches(ltrim(t, ' ' || chr(10)), '^[=+@\\-]') THEN '''' || t ELSE t END AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || lang WHEN doc_id % 3 = 1 THEN '  -' || lang ELSE lang END AS t FROM documents)")
def f19(spark, sf):
    i = F.col("doc_id")
    t = F.when(i % 3 == 0, F.concat(F.lit("="), "lang")).when(i % 3 == 1, F.concat(F.lit("  -"), "lang")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.guard_formula(t).alias("safe"))


@query("f20_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def f20(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape("html").alias("escaped"))


@query("f21_export_time", FILE_ENTRIES_SQL + "SELECT entry_id, CASE WHEN mtime_sec IS NOT NULL THEN mtime_sec || '.' || lpad(mtime_nsec::VARCHAR, 9, '0') || 'Z' END AS mtime FROM file_entries")
def f21(spark, sf):
    return file_entries(spark, sf).select("entry_id", X.export_time("mtime_sec", "mtime_nsec").alias("mtime"))


@query("f23_format_bytes", ORDER_ENTRIES_SQL + "SELECT entry_id, CASE WHEN size_bytes >= 1073741824 THEN (size_bytes // 1073741824) || '.' || lpad(((size_bytes % 1073741824) * 100 // 1073741824)::VARCHAR, 2, '0') || ' GiB' WHEN size_bytes >= 1048576 THEN (size_bytes // 1048576) || '.' || lpad(((size_bytes % 1048576) * 100 // 1048576)::VARCHAR, 2, '0') || ' MiB' WHEN size_bytes >= 1024 THEN (size_bytes // 1024) || '.' || lpad(((size_bytes % 1024) * 100 // 1024)::VARCHAR, 2, '0') || ' KiB' ELSE size_bytes || ' B' END AS shown FROM order_entries")
def f23(spark, sf):
    return order_entries(spark, sf).select("entry_id", X.format_bytes("size_bytes").alias("shown"))


@query("f18_json_path", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def f18(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("f31_block_bytes", "SELECT p_partkey, (p_partkey::DECIMAL(20, 0) * 4096)::DECIMAL(38, 0) AS bytes FROM part")
def f31(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.bytes_of_blocks("p_partkey", F.lit(4096)).cast("decimal(38,0)").alias("bytes"))


@query("s1_folder_sort", FILE_ENTRIES_SQL + """, up AS (SELECT source_id, size_bytes, array_to_string(p[1:i], '/') AS path FROM (SELECT *, string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS i FROM file_entries)),
f AS (SELECT source_id, path, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS logical_bytes FROM up GROUP BY 1, 2)
SELECT source_id, path, logical_bytes, row_number() OVER (ORDER BY logical_bytes DESC NULLS LAST, source_id, path) AS place FROM f ORDER BY place LIMIT 40""")
def s1(spark, sf):
    order = Q.metric_order("logical_bytes", True, ("source_id", "path"))
    return _placed(directory_rollup(file_entries(spark, sf)).select("source_id", "path", "logical_bytes"), order, 40)


def _placed(rows, order, n):
    from pyspark.sql import Window

    top = rows.orderBy(*order.columns()).limit(n)  # a page: its length is the feature
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order.columns())).cast("long"))


for _sort, _descending, _sql in (("size", True, "size_bytes DESC NULLS LAST"), ("size", False, "size_bytes ASC NULLS FIRST"), ("atime", True, "atime_sec DESC NULLS LAST, atime_nsec DESC NULLS LAST"), ("allocated", False, "allocated_bytes_estimate ASC NULLS FIRST"), ("mtime", False, "mtime_sec ASC NULLS FIRST, mtime_nsec ASC NULLS FIRST"), ("name", True, "display_name DESC"), ("owner", False, "uid ASC NULLS FIRST"), ("category", False, "category_id ASC")):

    @query(f"s2_sort_{_sort}_{'desc' if _descending else 'asc'}", FILE_ENTRIES_SQL + f"SELECT entry_id, row_number() OVER (ORDER BY {_sql}, entry_id) AS place FROM file_entries ORDER BY place LIMIT 200")
    def s2(spark, sf, sort=_sort, descending=_descending):
        return _placed(file_entries(spark, sf), Q.order_of(Q.QuerySpec(sort=sort, descending=descending)), 200).select("entry_id", "place")


@query("s4_owner_sort", FILE_ENTRIES_SQL + "SELECT uid, row_number() OVER (ORDER BY uid NULLS FIRST) AS place FROM (SELECT DISTINCT uid FROM file_entries)")
def s4(spark, sf):
    # place by ranges of owners, the unknown one (null) first
    owners = file_entries(spark, sf).select(F.coalesce("uid", F.lit(-1)).alias("key"), "uid", F.lit(0).alias("all")).distinct()
    return sum_before(owners, ["all"], F.col("key"), F.lit(1), "earlier").select("uid", (F.col("earlier") + 1).cast("long").alias("place"))


@query("s5_category_sort", FILE_ENTRIES_SQL + ", c AS (SELECT category_id, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS logical_bytes FROM file_entries GROUP BY 1) SELECT category_id, logical_bytes, row_number() OVER (ORDER BY logical_bytes DESC NULLS LAST, category_id) AS place FROM c ORDER BY place LIMIT 50")
def s5(spark, sf):
    return _placed(grouped_sizes(file_entries(spark, sf), "category_id").select("category_id", "logical_bytes"), Q.metric_order("logical_bytes", True, ("category_id",)), 50)


@query("p11_largest_filtered", FILE_ENTRIES_SQL + "SELECT entry_id, rank FROM (SELECT *, row_number() OVER (ORDER BY size_bytes DESC, entry_id) AS rank FROM file_entries WHERE size_bytes IS NOT NULL) WHERE rank <= 200 AND category_id IN ('archives', 'pictures') AND size_bytes >= 3000")
def p11(spark, sf):
    spec = Q.QuerySpec(category_ids=("archives", "pictures"), min_size_bytes="3000").check_section("largest")
    return Q.find(ranking(file_entries(spark, sf), "largest"), spec).select("entry_id", F.col("rank").cast("long").alias("rank"))


@query("p13_direct_children", FILE_ENTRIES_SQL + "SELECT entry_id FROM file_entries WHERE source_id = 'src0' AND starts_with(path, 'en/d1/') AND NOT contains(substr(path, 7), '/')")
def p13(spark, sf):
    return Q.direct_children(file_entries(spark, sf), "src0", "en/d1").select("entry_id")


@query("p15_scope", FILE_ENTRIES_SQL + "SELECT 'current' AS scope, count(*) AS n FROM file_entries WHERE extension = 'txt' UNION ALL SELECT 'all', count(*) FROM file_entries")
def p15(spark, sf):
    spec, files = Q.QuerySpec(extensions=("txt",)), file_entries(spark, sf)
    current, every = (Q.find(files, spec.scoped(s)).agg(F.lit(s).alias("scope"), F.count(F.lit(1)).alias("n")) for s in ("current", "all"))
    return current.unionByName(every)


@query("f3_derived_ruleset", FILE_ENTRIES_SQL + "SELECT CASE WHEN extension = 'bin' THEN 'documents' WHEN extension = 'ts' THEN 'other' ELSE category_id END AS category_id, count(*) AS n FROM file_entries GROUP BY 1")
def f3(spark, sf):
    category, _ = X.classify("display_name", DEFAULT_RULESET.derive({"bin": "documents"}, ["ts"]).mapping)
    return file_entries(spark, sf).groupBy(category.alias("category_id")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_valid_extensions", "SELECT p_partkey, regexp_full_match(e, '[a-z0-9+_-]+(\\.[a-z0-9+_-]+)*') AND length(e) <= 64 AS valid FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tar.' || p_partkey WHEN 1 THEN 'a..b' WHEN 2 THEN 'X' || p_partkey ELSE repeat('e', (p_partkey % 130)::INT) END AS e FROM part)")
def f4(spark, sf):
    i = F.col("p_partkey")
    e = F.when(i % 4 == 0, F.concat(F.lit("tar."), i.cast("string"))).when(i % 4 == 1, "a..b").when(i % 4 == 2, F.concat(F.lit("X"), i.cast("string"))).otherwise(F.expr("repeat('e', cast(p_partkey % 130 as int))"))
    return table(spark, sf, "part").select("p_partkey", X.valid_extension(e).alias("valid"))


@query("f7_display_paths", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || chr(65533) ELSE lang END AS path, doc_id % 3 = 0 AS warning FROM documents")
def f7(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("lang").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("lang").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", X.display_path(raw).alias("path"), X.encoding_warning(raw).alias("warning"))


@query("f13_cache_keys", FILE_ENTRIES_SQL + "SELECT entry_id, 'e7:d' || uid || ':i' || entry_id || ':s' || size_bytes || ':m' || mtime_sec || '.' || mtime_nsec || ':c' || mtime_sec || '.0:sha256v1' AS key FROM file_entries WHERE uid IS NOT NULL AND size_bytes IS NOT NULL")
def f13(spark, sf):
    rows = file_entries(spark, sf).filter("uid is not null and size_bytes is not null")
    key = X.hash_cache_key(F.lit(7), F.col("uid"), F.col("entry_id"), F.col("size_bytes"), (F.col("mtime_sec"), F.col("mtime_nsec")), (F.col("mtime_sec"), F.lit(0)))
    return rows.select("entry_id", key.alias("key"))


@query("f15_minutes", "SELECT event_id, date_trunc('minute', ts) AS floor, CASE WHEN date_trunc('minute', ts) = ts THEN ts ELSE date_trunc('minute', ts) + INTERVAL 1 MINUTE END AS ceil FROM events")
def f15(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", X.minute_floor(ts).cast("timestamp_ntz").alias("floor"), X.minute_ceil(ts).cast("timestamp_ntz").alias("ceil"))


@query("f22_numeric_order", "SELECT p_partkey, row_number() OVER (ORDER BY t::DECIMAL(38, 0), p_partkey) AS place FROM (SELECT p_partkey, '00' || (p_partkey * 7919 % 1000) || '000000000000000000' AS t FROM part) ORDER BY place LIMIT 100")
def f22(spark, sf):
    t = F.concat(F.lit("00"), (F.col("p_partkey") * 7919 % 1000).cast("string"), F.lit("0" * 18))
    return _placed(table(spark, sf, "part").select("p_partkey", X.numeric_order(t).alias("n")), Q.Order(("n",), tie=("p_partkey",)), 100).select("p_partkey", "place")


@query("f25_without_secrets", """SELECT event_id, '{"user":' || user_id || ',"at":[{"Session_Key":"<redacted>","k":"' || event_type || '"}]}' AS shown FROM events""")
def f25(spark, sf):
    text = F.format_string('{"user":%d, "at": [{"Session_Key": {"token": 1}, "k": "%s"}]}', "user_id", "event_type")
    return table(spark, sf, "events").select("event_id", X.without_secrets(text).alias("shown"))


@query("f26_path_overlaps", FILE_ENTRIES_SQL + "SELECT entry_id, starts_with(path, 'en/d1/') OR path = 'en/d1' AS overlaps FROM file_entries")
def f26(spark, sf):
    return file_entries(spark, sf).select("entry_id", X.path_overlaps("path", F.lit("/en/d1/")).alias("overlaps"))


@query("f27_retry_delays", "SELECT a AS attempt, CASE a WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 30 END AS minutes FROM (SELECT DISTINCT l_linenumber AS a FROM lineitem)")
def f27(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct().withColumn("minutes", X.retry_delay_minutes("attempt"))


@query("f29_scope_fingerprint", "SELECT sha256(unhex(hex('{\"all\":true}') || string_agg(hex(n_name) || hex('/' || n_name) || printf('%02x00000000000000', n_nationkey) || hex('online'), '' ORDER BY n_name))) AS fingerprint FROM nation")
def f29(spark, sf):
    sources = table(spark, sf, "nation").select(F.col("n_name").alias("source_id"), F.concat(F.lit("/"), "n_name").alias("root"), F.col("n_nationkey").cast("long").alias("epoch"), F.lit("online").alias("availability"))
    return X.scope_fingerprint('{"all":true}', sources)


@query("s6_pages_by_layout", FILE_ENTRIES_SQL + "SELECT entry_id, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, entry_id) AS place FROM file_entries ORDER BY place LIMIT 50 OFFSET 100")
def s6_layout(spark, sf):
    """The third page of the files by size, from a section stored in that order: a page opens the file it lies in."""
    files, order = file_entries(spark, sf).select("entry_id", "size_bytes"), Q.order_of(Q.QuerySpec(sort="size", descending=True))
    stored, last = StoredOrder.publish(files, order, new_folder(spark, "pages")), None
    for _ in range(3):
        shown, last = stored.page(50, last)
    return spark.createDataFrame([(r["entry_id"], 101 + k) for k, r in enumerate(shown)], "entry_id long, place long")


@query("s6_keyset_after_null", FILE_ENTRIES_SQL + "SELECT entry_id FROM file_entries WHERE size_bytes IS NULL AND entry_id > 100 ORDER BY entry_id LIMIT 50")
def s6(spark, sf):
    order = Q.Order(("size_bytes",), True)
    return file_entries(spark, sf).filter(order.after({"size_bytes": None, "entry_id": 100})).orderBy(*order.columns()).limit(50).select("entry_id")


@query("s7_keyset_time_pair", FILE_ENTRIES_SQL + "SELECT entry_id FROM file_entries WHERE mtime_sec IS NOT NULL AND (mtime_sec, mtime_nsec, entry_id) > (1620000000, 10, 5) ORDER BY mtime_sec, mtime_nsec, entry_id LIMIT 50")
def s7(spark, sf):
    order = Q.order_of(Q.QuerySpec(sort="mtime", descending=False))
    return file_entries(spark, sf).filter(order.after({"mtime_sec": 1620000000, "mtime_nsec": 10, "entry_id": 5})).orderBy(*order.columns()).limit(50).select("entry_id")
