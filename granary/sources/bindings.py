"""Storage-analytics tables derived from the driver's tables, and the same as SQL for comparison.

``file_entries``: one row for each file, from ``documents`` (content, hard-link aliases, unknown values).
``order_entries``: a large tree of files, from orders, customers, nations and regions.
``volume_samples``: a capacity series, from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import expressions as X

ALIAS_BASE = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_entries(spark: SparkSession, sf_dir: str, *, content: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("source_id"))
    i = F.col("doc_id")
    extension = F.element_at(F.array(*map(F.lit, ("txt", "tar.gz", "JPG", "ts", "config.json", "", "bin", "mp4"))), (i % 8 + 1).cast("int"))
    name = F.when(i % 53 == 0, F.concat(F.lit(".env"), i.cast("string"))).otherwise(F.concat_ws(".", i.cast("string"), extension))
    d = d.select("*", name.alias("display_name"), F.octet_length("text").cast("long").alias("n"), (i % 97 == 0).alias("unknown"))
    first = d.select("*", i.alias("entry_id"), F.concat(F.col("lang"), F.lit("/d"), (i % 5).cast("string"), F.lit("/"), F.col("display_name")).alias("path"))
    alias = d.filter(i % 20 == 0).select("*", (i + ALIAS_BASE).alias("entry_id"), F.concat(F.lit("alias/"), F.col("display_name")).alias("path"))
    both = first.unionByName(alias)
    known = ~F.col("unknown")
    category, ext = X.classify("display_name")
    return both.select(
        "entry_id", "source_id", "path", "display_name", F.lit("regular_file").alias("entry_kind"),
        F.when(known, F.concat_ws(":", "source_id", i.cast("string"))).alias("file_identity_key"),
        F.when(i % 41 != 0, i % 50).alias("uid"),
        F.when(i % 20 == 0, 2).otherwise(1).cast("long").alias("nlink"),
        F.when(known, F.col("n")).alias("size_bytes"),
        F.when(known & (i % 101 != 0), F.ceil(F.col("n") / 512).cast("long") * 512).alias("allocated_bytes_estimate"),
        F.when(known, F.lit(1600000000) + (i * 791919) % 50000000).alias("mtime_sec"), F.when(known, i % 1000).alias("mtime_nsec"),
        F.when(i % 13 != 0, F.lit(1650000000) + (i * 104729) % 40000000).alias("atime_sec"), F.when(i % 13 != 0, i % 7).alias("atime_nsec"),
        category.alias("category_id"), ext.alias("extension"), F.when(F.col("unknown"), F.lit("stat_failed")).alias("scan_error"),
        *([F.col("text").alias("content")] if content else []),
    )


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id and content of every file."""
    return file_entries(spark, sf_dir, content=True).select("entry_id", "content")


#: The same rows in SQL: put before a query that reads ``file_entries``.
FILE_ENTRIES_SQL = f"""
WITH named AS (
  SELECT doc_id, text, lang, source AS source_id, strlen(text) AS n, doc_id % 97 = 0 AS unknown,
    CASE WHEN doc_id % 53 = 0 THEN '.env' || doc_id ELSE doc_id || '.' ||
      ['txt', 'tar.gz', 'JPG', 'ts', 'config.json', '', 'bin', 'mp4'][doc_id % 8 + 1] END AS display_name,
    CASE WHEN doc_id % 53 = 0 THEN 'other' ELSE ['documents', 'archives', 'pictures', 'web_and_code', 'web_and_code', 'other', 'disk_images', 'videos'][doc_id % 8 + 1] END AS category_id,
    CASE WHEN doc_id % 53 = 0 THEN NULL ELSE ['txt', 'tar.gz', 'jpg', 'ts', 'json', NULL, 'bin', 'mp4'][doc_id % 8 + 1] END AS extension
  FROM documents),
placed AS (
  SELECT *, doc_id AS entry_id, lang || '/d' || (doc_id % 5) || '/' || display_name AS path FROM named
  UNION ALL SELECT *, doc_id + {ALIAS_BASE}, 'alias/' || display_name FROM named WHERE doc_id % 20 = 0),
file_entries AS (
  SELECT entry_id, source_id, path, display_name, 'regular_file' AS entry_kind,
    CASE WHEN NOT unknown THEN source_id || ':' || doc_id END AS file_identity_key,
    CASE WHEN doc_id % 41 <> 0 THEN doc_id % 50 END AS uid,
    CASE WHEN doc_id % 20 = 0 THEN 2 ELSE 1 END::BIGINT AS nlink,
    CASE WHEN NOT unknown THEN n END AS size_bytes,
    CASE WHEN NOT unknown AND doc_id % 101 <> 0 THEN ((n + 511) // 512) * 512 END AS allocated_bytes_estimate,
    CASE WHEN NOT unknown THEN 1600000000 + (doc_id * 791919) % 50000000 END AS mtime_sec, CASE WHEN NOT unknown THEN doc_id % 1000 END AS mtime_nsec,
    CASE WHEN doc_id % 13 <> 0 THEN 1650000000 + (doc_id * 104729) % 40000000 END AS atime_sec, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 7 END AS atime_nsec,
    category_id, extension, CASE WHEN unknown THEN 'stat_failed' END AS scan_error, text AS content
  FROM placed)
"""


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    owners = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")  # nations: 25 rows by definition
    j = orders.join(owners, F.col("o_custkey") == F.col("c_custkey"))
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "tar.gz", "mkv", "py"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return j.select(
        F.col("o_orderkey").alias("entry_id"), F.col("r_name").alias("source_id"),
        F.concat_ws("/", "n_name", "c_name", F.concat_ws(".", F.col("o_orderkey").cast("string"), ext)).alias("path"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"), (F.col("o_custkey") % 50).alias("uid"),
        F.col("o_orderdate").alias("modified"), F.col("o_orderkey").cast("string").alias("file_identity_key"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("allocated_bytes_estimate"),
    )


ORDER_ENTRIES_SQL = """
WITH order_entries AS (
  SELECT o_orderkey AS entry_id, r_name AS source_id,
    n_name || '/' || c_name || '/' || o_orderkey || '.' || ['pdf', 'tar.gz', 'mkv', 'py'][o_orderkey % 4 + 1] AS path,
    CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_custkey % 50 AS uid, o_orderdate AS modified
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree known by ids alone: entry_id, parent_entry_id, entry_kind, display_name, size_bytes. Regions are roots."""
    def rows(name: str, entry_id, parent_id, kind: str, shown, size):
        return table(spark, sf_dir, name).select(entry_id.cast("long").alias("entry_id"), parent_id.cast("long").alias("parent_entry_id"), F.lit(kind).alias("entry_kind"), shown.alias("display_name"), size.cast("long").alias("size_bytes"))

    none, k = F.lit(None), F.col
    folders = [
        rows("region", k("r_regionkey") + 1, none, "directory", k("r_name"), none), rows("nation", k("n_nationkey") + 100, k("n_regionkey") + 1, "directory", k("n_name"), none),
        rows("customer", k("c_custkey") + 1000, k("c_nationkey") + 100, "directory", k("c_name"), none),
    ]
    files = rows("orders", k("o_orderkey") + ALIAS_BASE, k("o_custkey") + 1000, "regular_file", k("o_orderkey").cast("string"), F.round(k("o_totalprice") * 100))
    return folders[0].unionByName(folders[1]).unionByName(folders[2]).unionByName(files)


ORDER_TREE_SQL = f"""
WITH RECURSIVE order_tree AS (
  SELECT r_regionkey + 1 AS entry_id, NULL::BIGINT AS parent_entry_id, 'directory' AS entry_kind, r_name AS display_name, NULL::BIGINT AS size_bytes FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, 'directory', n_name, NULL FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, 'directory', c_name, NULL FROM customer
  UNION ALL SELECT o_orderkey + {ALIAS_BASE}, o_custkey + 1000, 'regular_file', o_orderkey::VARCHAR, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders)
"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before minutes are thinned out: event_id tells which came first."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    used = F.round(F.col("value") * 100).cast("decimal(20,0)")
    ok = F.col("event_id") % 50 != 0
    total = F.lit(1000000).cast("decimal(20,0)")
    free = total - used
    available = F.greatest(free - F.pmod(F.col("event_id"), F.lit(7)), F.lit(0)).cast("decimal(20,0)")
    return events.select(
        "event_id", F.col("event_type").alias("volume_id"), F.col("ts").cast("timestamp").alias("ts"), X.minute_floor(F.col("ts").cast("timestamp")).alias("sample_time"),
        F.when(ok, total).alias("total_bytes"), F.when(ok, free.cast("decimal(20,0)")).alias("free_bytes"), F.when(ok, available).alias("available_bytes"),
        F.when(ok, used).alias("used_bytes"), F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("quality"),
    )


def volume_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.operators.capacity import first_per_minute

    return first_per_minute(raw_samples(spark, sf_dir))


SAMPLES_SQL = """
WITH raw AS (
  SELECT event_id, event_type AS volume_id, ts, date_trunc('minute', ts) AS sample_time, CAST(round(value * 100) AS DECIMAL(20, 0)) AS used, event_id % 50 <> 0 AS good FROM events),
volume_samples AS (
  SELECT event_id, volume_id, sample_time,
    CASE WHEN good THEN CAST(1000000 AS DECIMAL(20, 0)) END AS total_bytes, CASE WHEN good THEN CAST(1000000 - used AS DECIMAL(20, 0)) END AS free_bytes,
    CASE WHEN good THEN CAST(greatest(1000000 - used - event_id % 7, 0) AS DECIMAL(20, 0)) END AS available_bytes, CASE WHEN good THEN used END AS used_bytes,
    CASE WHEN good THEN 'ok' ELSE 'error' END AS quality
  FROM raw QUALIFY row_number() OVER (PARTITION BY volume_id, sample_time ORDER BY event_id) = 1)
"""
