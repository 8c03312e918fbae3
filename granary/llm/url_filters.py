"""URL filters: exact membership in key lists by a cascade of Bloom filters.

Level 0 encodes the listed keys. Of all keys that the corpus can ask for (its key universe), some that
are not listed pass level 0; level 1 encodes these. Listed keys that pass level 1 are encoded by level
2, and so on until a level is passed by no wrong key. Over this universe the alternating answers are
exact, and a lookup tests bits only: no join, no Python. Level 0 has as many bits a key as the universe's
size asks, so that about as many wrong keys pass as keys are listed; the others have ``bits_per_key``.

Levels are built by aggregation: keys that pass are found where they lie, in one pass for all lists of a
cascade, and only the few false positives are shuffled. A level is an array of chunks of at most
``max_words`` 64-bit words, each gathered by itself; lookups read it through a scalar subquery. All lists
of a level may have ``max_total`` words (32 MB), about 30 million keys. Longer lists are looked up by
semi-joins instead, with the same answers (:meth:`BloomCascade.filter_members`, :func:`judge_urls`).

Defined cases: a null key is not listed; an empty list contains nothing; repeated keys count once; a
null url, or one without ``://``, has an empty host and path; repeated pages (and those without page_id) are
judged each; a rule listed with both verdicts blocks; extra columns of the pages are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import durable


@dataclass(frozen=True)
class Filter:
    """Where the bits of a list are in its level: ``chunks`` chunks of ``words`` words from number ``start`` on."""

    level: int
    start: int
    chunks: int
    words: int
    hashes: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level * 64 + j)), F.lit(self.chunks * self.words * 64)) for j in range(self.hashes)]

    def passes(self, key: Column, bits: Column) -> Column:
        """Whether all bits of a key are set in a level (array of arrays of long)."""
        out = F.lit(True)
        for p in self.positions(key):
            word = F.floor(p / 64)
            chunk = F.element_at(bits, (F.floor(word / self.words) + (self.start + 1)).cast("int"))
            out = out & (F.getbit(F.element_at(chunk, (word % self.words + 1).cast("int")), (p % 64).cast("int")) == 1)
        return out


def filter_level(keys: DataFrame, filters: dict[int, Filter], max_total: int) -> DataFrame:
    """One row: the bits of a level, as chunks. keys: list and key."""
    set_bits = None
    for name, f in filters.items():
        own = keys.filter(F.col("list") == name).select(F.explode(F.array(*f.positions(F.col("key")))).alias("p"))
        own = own.select(F.floor(F.col("p") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("bits"))
        own = own.select((F.floor(F.col("word") / f.words) + f.start).cast("int").alias("chunk"), (F.col("word") % f.words).cast("int").alias("at"), "bits")
        none = keys.sparkSession.range(f.chunks * f.words).select((F.floor(F.col("id") / f.words) + f.start).cast("int").alias("chunk"), (F.col("id") % f.words).cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
        set_bits = own.unionByName(none) if set_bits is None else set_bits.unionByName(own).unionByName(none)
    dense = set_bits.groupBy("chunk", "at").agg(F.bit_or("bits").alias("bits"))
    chunk = dense.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("all")).select("chunk", F.transform("all", lambda x: x["bits"]).alias("words"))
    return chunk.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "words"))), lambda x: x["words"]).alias("bits"))  # at most max_total words


@dataclass
class BloomCascade:
    """A built cascade of one list or several; ``levels`` are tables of one row each."""

    bits_per_key: int = 8
    max_words: int = 1 << 16
    max_total: int = 1 << 22
    levels: list[DataFrame] = field(default_factory=list)
    filters: list[dict[int, Filter]] = field(default_factory=list)
    listed: DataFrame | None = None
    fits: bool = True

    def build(self, listed: DataFrame, universe: DataFrame) -> BloomCascade:
        """listed: key, and list (a number) if there are several. universe: key, every key that will be asked for, repeats allowed."""
        number = F.col("list").cast("int") if "list" in listed.columns else F.lit(0)
        keys = listed.select(number.alias("list"), F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct()
        self.listed = durable(keys, "listed")
        asked = universe.select(F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull())
        wanted, own, size = self.listed, None, None
        while self.fits and (counts := {r["list"]: r["n"] for r in wanted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}):  # a row a list
            if size is None:
                size = asked.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
            level, filters, start = len(self.levels), {}, 0
            for name, n in sorted(counts.items()):
                # bits for about one wrong key of the universe to a listed one at level 0, and for few of the level before later on
                bits = max(self.bits_per_key, math.ceil(1.44 * math.log2(max(size / n, 2)))) if level == 0 else self.bits_per_key
                total = -(-bits * n // 64)
                chunks = -(-total // self.max_words)
                filters[name] = Filter(level, start, chunks, -(-total // chunks), max(1, round(0.69 * bits)))
                start += chunks
            if sum(f.chunks * f.words for f in filters.values()) > self.max_total:
                self.levels, self.filters, self.fits = [], [], False
                return self
            self.levels.append(durable(filter_level(wanted, filters, self.max_total), f"cascade-level-{level}"))
            self.filters.append(filters)
            bits = self.levels[-1].scalar()
            if level == 0:  # all keys asked for, for all lists in one pass
                hit = [F.when(f.passes(F.col("key"), F.col("bits")), F.lit(name)) for name, f in filters.items()]
                passed = asked.withColumn("bits", bits).select(F.explode(F.array_compact(F.array(*hit))).alias("list"), "key").distinct()
            else:  # the keys that the level before encodes
                hit = F.lit(False)
                for name, f in filters.items():
                    hit = hit | ((F.col("list") == name) & f.passes(F.col("key"), F.col("bits")))
                passed = own.withColumn("bits", bits).filter(hit).select("list", "key")
            own, wanted = wanted, durable(passed.join(wanted, ["list", "key"], "left_anti"), f"cascade-{level}")
        return self

    def attach(self, df: DataFrame, prefix: str) -> DataFrame:
        """df with a column of bits for each level: constants that each row's expressions can read."""
        return df.withColumns({f"{prefix}{i}": t.scalar() for i, t in enumerate(self.levels)})

    def contains(self, key: Column, prefix: str, name: int = 0) -> Column:
        """Whether a key of the universe is in a list, on a table from :meth:`attach`."""
        out = F.lit(False)
        for i, filters in reversed(list(enumerate(self.filters))):
            if name in filters:
                out = filters[name].passes(key, F.col(f"{prefix}{i}")) & ~out
        return F.coalesce(out, F.lit(False))

    def filter_members(self, df: DataFrame, key: str = "key") -> DataFrame:
        """The rows of df whose key is listed (list 0): by the cascade, or by a semi-join for a list beyond the bound."""
        names = [F.col(f"`{n}`") for n in df.columns]
        if not self.fits:
            return df.join(self.listed.filter("list = 0").select(F.col("key").alias(key)), key, "left_semi").select(*names)
        return self.attach(df, "__level").filter(self.contains(F.col(key), "__level")).select(*names)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every rule that could fit: each suffix of the host at a dot, with each beginning of the path of a listed length."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def keys(n: int) -> Column:
        begun = F.substring(path, 1, n)
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda s: F.concat(s, begun))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(keys, path_lengths)))


def judge_urls(pages: DataFrame, rules: dict[str, str] | DataFrame, blocked_hosts: list[str] | DataFrame = (), *, cascade: BloomCascade | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    rules: ``host/path`` (the path begins at the first slash) to ``allow`` or ``block``, as a dictionary or
    as a table (key, verdict); a rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest rule wins. Where no rule fits, a page is blocked if its host or a domain above it
    is in ``blocked_hosts`` (a list, or a table with a column key).
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    if isinstance(rules, dict):
        rules = spark.createDataFrame(list(rules.items()), "key string, verdict string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(k,) for k in blocked_hosts], "key string")
    lengths = sorted(r[0] for r in rules.select((F.length("key") - F.instr("key", "/") + 1).alias("n")).distinct().collect())  # as many as there are lengths of paths
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    asked = base.select("*", rule_keys(F.col("host"), F.col("path"), lengths).alias("rule_keys"), rule_keys(F.col("host"), F.col("path"), [0]).alias("host_keys"))
    # list 0: all rules; list 1: rules that block, and hosts
    blocking = rules.filter(F.col("verdict") == "block").select("key").unionByName(blocked_hosts.select("key"))
    listed = rules.select(F.lit(0).alias("list"), "key").unionByName(blocking.select(F.lit(1).alias("list"), "key"))
    cascade = (cascade or BloomCascade()).build(listed, asked.select(F.explode(F.concat("rule_keys", "host_keys")).alias("key")))
    if not cascade.fits:
        return _judged_by_joins(asked, cascade.listed)
    out = cascade.attach(asked, "__bits")
    fitting = F.filter("rule_keys", lambda k: cascade.contains(k, "__bits"))
    out = out.withColumn("rule", _longest(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))))
    hit = F.exists("host_keys", lambda k: cascade.contains(k, "__bits", 1))
    block = F.when(F.col("rule").isNotNull(), cascade.contains(F.col("rule"), "__bits", 1)).otherwise(hit)
    return out.select("page_id", "host", "path", "rule", F.when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def _longest(found: Column) -> Column:
    return F.array_max(found)["key"]


def _judged_by_joins(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The same verdicts for lists too long for a cascade: keys meet the lists by semi-joins, and pages their keys by number."""
    asked = durable(asked.withColumn("number", F.monotonically_increasing_id()), "asked")
    of = lambda n: listed.filter(F.col("list") == n).select("key")
    fitting = asked.select("number", F.explode("rule_keys").alias("key")).join(of(0), "key", "left_semi")
    longest = fitting.groupBy("number").agg(F.max(F.struct(F.length("key").alias("n"), "key"))["key"].alias("rule"))
    ruled = longest.join(of(1).select(F.col("key").alias("rule"), F.lit(True).alias("rule_blocks")), "rule", "left")
    hosts = asked.select("number", F.explode("host_keys").alias("key")).join(of(1), "key", "left_semi").select("number", F.lit(True).alias("host_blocks")).distinct()
    out = asked.join(ruled, "number", "left").join(hosts, "number", "left")
    block = F.coalesce(F.when(F.col("rule").isNotNull(), F.col("rule_blocks")).otherwise(F.col("host_blocks")), F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
