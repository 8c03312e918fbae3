"""Aggregates, rollups, rankings and duplicates over file entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import expressions as X
from granary.operators import aggregates as A
from granary.operators import duplicates as D
from granary.operators.digest_cache import DigestCache
from granary.operators.rankings import ranking
from granary.registry import query
from granary.sources.bindings import ALIAS_BASE, FILE_ENTRIES_SQL, ORDER_ENTRIES_SQL, file_contents, file_entries, order_entries, table
from granary.sources.stages import new_folder

STRICT = "CASE WHEN count({0}) = count(*) THEN sum({0})::BIGINT END"
_SIZE, _ALLOC = STRICT.format("size_bytes"), STRICT.format("allocated_bytes_estimate")


@query("a1_strict_sum", "SELECT l_returnflag, count(*) AS n, CASE WHEN count(x) = count(*) THEN sum(x)::BIGINT END AS total FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'A' OR l_orderkey % 97 <> 0 THEN l_quantity::BIGINT END AS x FROM lineitem) GROUP BY 1")
def a1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.when((F.col("l_returnflag") != "A") | (F.col("l_orderkey") % 97 != 0), F.col("l_quantity").cast("long")).alias("x"))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), A.strict_sum("x").alias("total"))


@query("a2_owner_aggregate", FILE_ENTRIES_SQL + f"SELECT source_id, uid, count(*) AS file_count, {_SIZE} AS logical_bytes FROM file_entries GROUP BY 1, 2")
def a2(spark, sf):
    return A.owner_aggregate(file_entries(spark, sf))


@query("a3_first_occurrence", FILE_ENTRIES_SQL + "SELECT entry_id, file_identity_key IS NOT NULL AND entry_id = min(entry_id) OVER (PARTITION BY file_identity_key) AS is_first FROM file_entries")
def a3(spark, sf):
    return A.with_first_occurrence(file_entries(spark, sf)).select("entry_id", "is_first")


_ROLLUP = """, marked AS (
  SELECT *, file_identity_key IS NOT NULL AND entry_id = min(entry_id) OVER (PARTITION BY file_identity_key) AS is_first, string_split(path, '/') AS parts FROM {t}),
up AS (
  SELECT *, array_to_string(parts[1:k], '/') AS dir FROM (SELECT *, unnest(range(0, len(parts))) AS k FROM marked)),
dirs AS (SELECT DISTINCT source_id, dir FROM up),
inner_dirs AS (
  SELECT source_id, array_to_string(p[1:k], '/') AS dir, count(*) AS dir_count FROM (
    SELECT source_id, string_split(dir, '/') AS p, unnest(range(0, len(string_split(dir, '/')))) AS k FROM dirs WHERE dir <> '') GROUP BY 1, 2)
SELECT up.source_id, up.dir AS path, count(*) AS file_count,
  CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS logical_bytes,
  CASE WHEN bool_or(file_identity_key IS NULL OR size_bytes IS NULL) THEN NULL ELSE coalesce(sum(size_bytes) FILTER (is_first), 0)::BIGINT END AS unique_bytes,
  CASE WHEN bool_or(file_identity_key IS NULL OR allocated_bytes_estimate IS NULL) THEN NULL ELSE coalesce(sum(allocated_bytes_estimate) FILTER (is_first), 0)::BIGINT END AS allocated_bytes,
  coalesce(any_value(dir_count), 0)::BIGINT AS dir_count
FROM up LEFT JOIN inner_dirs USING (source_id, dir) GROUP BY 1, 2"""


@query("a4_directory_rollup", FILE_ENTRIES_SQL + _ROLLUP.format(t="file_entries"))
def a4(spark, sf):
    return A.directory_rollup(file_entries(spark, sf))


@query("a4_order_tree_rollup", ORDER_ENTRIES_SQL + """, up AS (SELECT source_id, size_bytes, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS path FROM order_entries)
SELECT source_id, path, count(*) AS file_count, sum(size_bytes)::BIGINT AS logical_bytes FROM up GROUP BY 1, 2""")
def a4_orders(spark, sf):
    return A.directory_rollup(order_entries(spark, sf)).select("source_id", "path", "file_count", "logical_bytes")


_CATEGORY = """, marked AS (SELECT *, file_identity_key IS NOT NULL AND entry_id = min(entry_id) OVER (PARTITION BY file_identity_key) AS is_first FROM file_entries),
categories AS (
  SELECT source_id, category_id, count(*) AS file_count, CASE WHEN count(size_bytes) = count(*) THEN sum(size_bytes)::BIGINT END AS logical_bytes,
    CASE WHEN bool_or(file_identity_key IS NULL OR is_first AND allocated_bytes_estimate IS NULL) THEN NULL ELSE coalesce(sum(allocated_bytes_estimate) FILTER (is_first), 0)::BIGINT END AS allocated_bytes
  FROM marked GROUP BY 1, 2) """


@query("a5_category_aggregate", FILE_ENTRIES_SQL + _CATEGORY + "SELECT * FROM categories")
def a5(spark, sf):
    return A.category_aggregate(file_entries(spark, sf))


@query("a6_owner_category", FILE_ENTRIES_SQL + f"SELECT source_id, uid, category_id, count(*) AS file_count, {_SIZE} AS logical_bytes, {_ALLOC} AS allocated_bytes FROM file_entries WHERE category_id IS NOT NULL GROUP BY 1, 2, 3")
def a6(spark, sf):
    return A.grouped_sizes(file_entries(spark, sf).filter(F.col("category_id").isNotNull()), "source_id", "uid", "category_id")


@query("a7_category_extension", FILE_ENTRIES_SQL + f"SELECT source_id, category_id, extension, count(*) AS file_count, {_SIZE} AS logical_bytes, {_ALLOC} AS allocated_bytes FROM file_entries GROUP BY 1, 2, 3")
def a7(spark, sf):
    return A.grouped_sizes(file_entries(spark, sf), "source_id", "category_id", "extension")


@query("a8_report_totals", FILE_ENTRIES_SQL + _CATEGORY + f"SELECT sum(file_count)::BIGINT AS files, {STRICT.format('logical_bytes')} AS logical_bytes, {STRICT.format('allocated_bytes')} AS allocated_bytes FROM categories")
def a8(spark, sf):
    return A.report_totals(A.category_aggregate(file_entries(spark, sf)))


@query("a9_owner_page", FILE_ENTRIES_SQL + f", owners AS (SELECT source_id, uid, count(*) AS file_count, {_SIZE} AS logical_bytes FROM file_entries GROUP BY 1, 2) SELECT uid, sum(file_count)::BIGINT AS file_count, {STRICT.format('logical_bytes')} AS logical_bytes, count(*) AS sources FROM owners GROUP BY 1")
def a9(spark, sf):
    return A.owner_page(A.owner_aggregate(file_entries(spark, sf)))


@query("a10_owner_breakdown", FILE_ENTRIES_SQL + f", t AS (SELECT uid, category_id, count(*) AS n, {_SIZE} AS b FROM file_entries GROUP BY 1, 2) SELECT uid, string_agg(category_id || '=' || n || '/' || coalesce(b::VARCHAR, '?'), ',' ORDER BY category_id) AS categories FROM t GROUP BY 1")
def a10(spark, sf):
    b = A.breakdown(A.grouped_sizes(file_entries(spark, sf), "uid", "category_id"), "uid", "category_id")
    text = F.transform(F.map_entries("by_category_id"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["file_count"].cast("string"), F.lit("/"), F.coalesce(e["value"]["logical_bytes"].cast("string"), F.lit("?"))))
    return b.select("uid", F.array_join(text, ",").alias("categories"))


@query("a11_category_page_directory", FILE_ENTRIES_SQL + f"SELECT category_id, count(*) AS file_count, {_SIZE} AS logical_bytes, {_ALLOC} AS allocated_bytes FROM file_entries WHERE source_id = 'src0' AND path LIKE 'en/%' GROUP BY 1")
def a11(spark, sf):
    from granary.operators.file_query import subtree

    return A.grouped_sizes(subtree(file_entries(spark, sf), "src0", "en"), "category_id")


@query("a12_size_buckets", FILE_ENTRIES_SQL + "SELECT size_bytes, count(DISTINCT file_identity_key) AS identities FROM file_entries WHERE size_bytes >= 1 GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1")
def a12(spark, sf):
    return D.size_buckets(file_entries(spark, sf))


_GROUPS = """, hashed AS (SELECT *, sha256(content) AS sha256 FROM file_entries WHERE size_bytes >= 1 AND file_identity_key IS NOT NULL),
groups AS (
  SELECT size_bytes, 'size:' || size_bytes AS candidate_key, sha256, count(*) AS member_count, count(DISTINCT file_identity_key) AS identities, least(count(*), 1000) AS listed_member_count,
    (count(DISTINCT file_identity_key) - 1) * size_bytes AS logical_redundancy_bytes, count(*) > 1000 AS truncated, CASE WHEN count(*) > 1000 THEN 'hash_incomplete' ELSE 'hash_complete' END AS verification
  FROM hashed GROUP BY 1, 2, 3 HAVING count(DISTINCT file_identity_key) > 1) """


def _hashed(spark, sf):
    return D.hashed(D.candidates(file_entries(spark, sf)), file_contents(spark, sf))


@query("a13_duplicate_groups", FILE_ENTRIES_SQL + _GROUPS + "SELECT * FROM groups")
def a13(spark, sf):
    return D.groups(_hashed(spark, sf))


@query("a14_redundancy_total", FILE_ENTRIES_SQL + _GROUPS + "SELECT count(*) AS group_count, sum(logical_redundancy_bytes)::DECIMAL(38, 0) AS redundant_bytes FROM groups")
def a14(spark, sf):
    return D.redundancy_total(D.groups(_hashed(spark, sf)))


@query("d1_size_candidates", FILE_ENTRIES_SQL + ", b AS (SELECT size_bytes FROM file_entries WHERE size_bytes >= 1 GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1) SELECT entry_id, 'size:' || size_bytes || '|name:' || lower(hex(display_name)) || '|mtime:' || mtime_sec || '.' || mtime_nsec AS candidate_key FROM file_entries WHERE size_bytes IN (FROM b) AND file_identity_key IS NOT NULL")
def d1(spark, sf):
    return D.candidates(file_entries(spark, sf), same_name=True, same_mtime=True).select("entry_id", "candidate_key")


@query("d3_skip_reasons", FILE_ENTRIES_SQL + "SELECT source_id, CASE WHEN source_id = 'src1' THEN 'source_unavailable' WHEN source_id = 'src2' THEN 'metadata_only' WHEN uid % 10 = 3 THEN 'remote_content_disallowed' WHEN size_bytes > 20000 THEN 'hash_budget_exceeded' END AS skip_reason, count(*) AS n FROM file_entries GROUP BY 1, 2")
def d3(spark, sf):
    reason = D.skip_reason(F.col("source_id") != "src1", F.col("source_id") == "src2", F.col("uid") % 10 == 3, F.col("size_bytes") > 20000)
    return file_entries(spark, sf).groupBy("source_id", reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


#: Samples of 200 bytes beyond 600: the texts are short. Of the same layout as the defaults.
_SAMPLES = """, s AS (SELECT entry_id, size_bytes, CASE WHEN size_bytes > 600 THEN substr(hex(content), 1, 400) || substr(hex(content), 2 * (size_bytes // 2 - 100) + 1, 400) || substr(hex(content), 2 * (size_bytes - 200) + 1, 400) END AS sample
  FROM file_entries WHERE size_bytes >= 1 AND file_identity_key IS NOT NULL), b AS (SELECT size_bytes FROM file_entries WHERE size_bytes >= 1 GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1) """


@query("d4_sample_survivors", FILE_ENTRIES_SQL + _SAMPLES + "SELECT entry_id FROM s WHERE size_bytes IN (FROM b) QUALIFY sample IS NULL OR count(*) OVER (PARTITION BY size_bytes, sample) > 1")
def d4(spark, sf):
    found = D.sampled(D.candidates(file_entries(spark, sf)), file_contents(spark, sf), region=200, threshold=600)
    return D.survivors(found, threshold=600).select("entry_id")


_LE = "printf('%02x%02x%02x%02x00000000', {0} % 256, {0} // 256 % 256, {0} // 65536 % 256, {0} // 16777216)"


@query("f12_sample_fingerprints", FILE_ENTRIES_SQL + ", p AS (SELECT entry_id, size_bytes AS n, hex(content) AS h, unnest([0, size_bytes // 2 - 100, size_bytes - 200]) AS o, unnest([1, 2, 3]) AS k FROM file_entries WHERE size_bytes > 600)"
  + f" SELECT entry_id, sha256(unhex('01000000' || {_LE.format('n')} || string_agg({_LE.format('o')} || {_LE.format('200')} || substr(h, 2 * o + 1, 400), '' ORDER BY k))) AS sample_hash FROM p GROUP BY entry_id, n")
def f12(spark, sf):
    return D.sampled(file_entries(spark, sf).filter("size_bytes > 600"), file_contents(spark, sf), region=200, threshold=600).select("entry_id", "sample_hash")


#: At the defaults: regions of 64 KiB beyond 192 KiB. Texts that ten times over are longer than that stand for large files.
_LARGE = """, large AS (SELECT entry_id, 10 * size_bytes AS n, repeat(content, 10) AS content FROM file_entries WHERE 10 * size_bytes > 196608),
p AS (SELECT entry_id, n, hex(content) AS h, unnest([0, n // 2 - 32768, n - 65536]) AS o, unnest([1, 2, 3]) AS k FROM large),
s AS (SELECT entry_id, n, sha256(unhex('01000000' || """ + _LE.format("n") + " || string_agg(" + _LE.format("o") + " || " + _LE.format("65536") + """ || substr(h, 2 * o + 1, 131072), '' ORDER BY k))) AS sample_hash FROM p GROUP BY entry_id, n) """


def _large(spark, sf):
    files = file_entries(spark, sf).withColumn("size_bytes", 10 * F.col("size_bytes")).filter(F.col("size_bytes") > X.SAMPLE_THRESHOLD)
    return files, file_contents(spark, sf).withColumn("content", F.repeat("content", F.lit(10)))


@query("f12_default_regions", FILE_ENTRIES_SQL + _LARGE + "SELECT entry_id, sample_hash FROM s")
def f12_large(spark, sf):
    files, contents = _large(spark, sf)
    return D.sampled(files.select("entry_id", "size_bytes"), contents).select("entry_id", "sample_hash")


@query("d4_default_regions", FILE_ENTRIES_SQL + _LARGE + ", f AS (SELECT s.*, file_identity_key FROM s JOIN file_entries USING (entry_id) WHERE file_identity_key IS NOT NULL), b AS (SELECT n FROM f GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1) SELECT entry_id FROM f WHERE n IN (FROM b) QUALIFY count(*) OVER (PARTITION BY n, sample_hash) > 1")
def d4_large(spark, sf):
    files, contents = _large(spark, sf)
    return D.survivors(D.sampled(D.candidates(files), contents)).select("entry_id")


@query("d6_byte_budget", FILE_ENTRIES_SQL + ", b AS (SELECT size_bytes FROM file_entries WHERE size_bytes >= 1 GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1), c AS (SELECT entry_id, size_bytes FROM file_entries WHERE size_bytes IN (FROM b) AND file_identity_key IS NOT NULL) SELECT entry_id, sum(size_bytes) OVER (ORDER BY size_bytes, entry_id ROWS UNBOUNDED PRECEDING) <= 200000 AS within_budget FROM c")
def d6(spark, sf):
    return D.within_budget(D.candidates(file_entries(spark, sf)), 200000).select("entry_id", "within_budget")


@query("d8_duplicate_members", FILE_ENTRIES_SQL + _GROUPS + """, m AS (SELECT h.*, row_number() OVER (PARTITION BY h.size_bytes, h.sha256 ORDER BY entry_id) AS place, entry_id > min(entry_id) OVER (PARTITION BY file_identity_key) AS is_hardlink_alias
  FROM hashed h JOIN groups USING (size_bytes, sha256)) SELECT sha256, entry_id, is_hardlink_alias FROM m WHERE place <= 1000""")
def d8(spark, sf):
    found = _hashed(spark, sf)
    return D.members(found, D.groups(found))


@query("j7_member_details", FILE_ENTRIES_SQL + _GROUPS + """SELECT h.sha256, entry_id, path, uid, CASE WHEN h.size_bytes <= 2000 THEN h.sha256 END AS full_sha256 FROM hashed h JOIN groups USING (size_bytes, sha256)
  QUALIFY row_number() OVER (PARTITION BY h.size_bytes, h.sha256 ORDER BY entry_id) <= 1000""")
def j7(spark, sf):
    found = _hashed(spark, sf)
    digests = found.filter("size_bytes <= 2000")  # digests that are known: a left join keeps the other members
    return D.member_details(D.members(found, D.groups(found)), file_entries(spark, sf), digests).select("sha256", "entry_id", "path", "uid", "full_sha256")


def _cached(spark, sf):
    """Two runs over the same files with one cache; before the second some have been written to (another time, the same bytes)."""
    files = file_entries(spark, sf).withColumn("run_2_nsec", F.when(F.col("entry_id") % 7 == 0, F.col("mtime_nsec") + 1).otherwise(F.col("mtime_nsec")))
    cache = DigestCache(spark, new_folder(spark, "digest-cache"))
    contents, found = D.ContentTable(file_contents(spark, sf)), None
    for run, nsec in (("run-1", "mtime_nsec"), ("run-2", "run_2_nsec")):
        time = (F.col("mtime_sec"), F.col(nsec))
        keyed = files.withColumn("cache_key", X.hash_cache_key(F.lit(7), F.lit(1), F.col("entry_id") % ALIAS_BASE, F.col("size_bytes"), time, time))
        found = cache.hashed(D.candidates(keyed, keep=("cache_key",)), contents, run)
    return found


@query("f13_digest_cache", FILE_ENTRIES_SQL + f", b AS (SELECT size_bytes FROM file_entries WHERE size_bytes >= 1 GROUP BY 1 HAVING count(DISTINCT file_identity_key) > 1), c AS (SELECT *, CASE WHEN entry_id % 7 = 0 THEN mtime_nsec + 1 ELSE mtime_nsec END AS nsec FROM file_entries WHERE size_bytes IN (FROM b) AND file_identity_key IS NOT NULL) SELECT entry_id, sha256(content) AS full_sha256, NOT EXISTS (SELECT 1 FROM c o WHERE o.entry_id % {ALIAS_BASE} = c.entry_id % {ALIAS_BASE} AND o.mtime_nsec = c.nsec) AS was_read FROM c")
def f13_cache(spark, sf):
    return _cached(spark, sf).select("entry_id", "full_sha256", "was_read")


@query("j7_cached_groups", FILE_ENTRIES_SQL + _GROUPS + "SELECT * FROM groups")
def j7_cached(spark, sf):
    return D.groups(_cached(spark, sf))


@query("d10_complete_groups", FILE_ENTRIES_SQL + _GROUPS + "SELECT sha256, member_count, logical_redundancy_bytes FROM groups WHERE NOT truncated")
def d10(spark, sf):
    return D.groups(_hashed(spark, sf)).filter(~F.col("truncated")).select("sha256", "member_count", "logical_redundancy_bytes")


@query("d11_cleanup_eligibility", FILE_ENTRIES_SQL + "SELECT CASE WHEN uid = 0 THEN 'protected' WHEN nlink > 1 THEN 'hardlink' WHEN size_bytes IS NULL THEN 'missing' WHEN mtime_nsec > 900 THEN 'changed' END AS blocked, count(*) AS n FROM file_entries GROUP BY 1")
def d11(spark, sf):
    blocked = D.cleanup_blocked(F.col("uid") == 0, F.col("nlink"), F.col("entry_kind"), F.lit(True), F.col("size_bytes").isNotNull(), F.col("mtime_nsec") > 900)
    return file_entries(spark, sf).groupBy(blocked.alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


_RANK = "SELECT '{0}' AS kind, rank, entry_id, size_bytes FROM (SELECT *, row_number() OVER (ORDER BY {1}, entry_id) AS rank FROM file_entries WHERE size_bytes IS NOT NULL) WHERE rank <= 200"
for _kind, _order in (("largest", "size_bytes DESC"), ("recently_modified", "mtime_sec DESC NULLS LAST, mtime_nsec DESC NULLS LAST"), ("least_accessed", "atime_sec ASC NULLS FIRST, atime_nsec ASC NULLS FIRST")):

    @query(f"s3_rank_{_kind}", FILE_ENTRIES_SQL + _RANK.format(_kind, _order))
    def s3(spark, sf, kind=_kind):
        return ranking(file_entries(spark, sf), kind).select("kind", F.col("rank").cast("long").alias("rank"), "entry_id", "size_bytes")


_TREE = """, dirs AS (SELECT DISTINCT source_id, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS k FROM file_entries)),
tree AS (SELECT source_id, path, CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END AS parts FROM (SELECT source_id, path FROM dirs UNION SELECT source_id, path FROM file_entries)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY parts) AS p FROM tree),
sizes AS (SELECT a.source_id, a.path, count(*) AS n FROM tree a JOIN tree b ON a.source_id = b.source_id AND (a.path = '' OR b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY 1, 2)
SELECT source_id, path, 2 * p - 1 - len(parts) AS dfs_left, 2 * p - 1 - len(parts) + 2 * n - 1 AS dfs_right FROM numbered JOIN sizes USING (source_id, path)"""


@query("p7_nested_intervals", FILE_ENTRIES_SQL + _TREE)
def p7_nested(spark, sf):
    files = file_entries(spark, sf)
    return A.nested_intervals(A.directories(files).unionByName(files.select("source_id", "path")).distinct())
