"""Scalar expressions and aggregates of storage analytics, as functions of columns.

All are built from Spark's own functions, so they stay inside code generation and may be pushed down.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.categories import DEFAULT_RULESET, OTHER

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- sums that never hide unknown values -------------------------------------------------------


def strict_sum(x: Column | str) -> Column:
    """Sum, or null if any input is null (or there is none)."""
    return F.when(F.count(col(x)) == F.count(F.lit(1)), F.sum(col(x)))


def rollup_sum(x: Column | str, unknown: Column) -> Column:
    """Sum (0 of nothing), or null if ``unknown`` holds for any row."""
    return F.when(F.coalesce(F.max(unknown.cast("int")), F.lit(0)) == 1, F.lit(None)).otherwise(F.coalesce(F.sum(col(x)), F.lit(0))).cast("long")


# --- names, extensions, paths ------------------------------------------------------------------


def ascii_lower(x: Column) -> Column:
    """A-Z only: other letters stay, in any locale."""
    return F.translate(x, _UPPER, _LOWER)


def classify(name: Column | str, mapping: dict[str, str] | None = None) -> tuple[Column, Column]:
    """Category and extension of a file name: the longest known suffix after the first dot wins."""
    mapping = DEFAULT_RULESET.mapping if mapping is None else mapping
    bare = F.regexp_replace(ascii_lower(col(name)), r"^\.", "")
    parts = F.split(bare, r"\.")
    # the suffixes after the first dot, longest first
    n = F.size(parts)
    suffixes = F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))
    known = F.create_map(*(F.lit(x) for pair in sorted(mapping.items()) for x in pair)) if mapping else F.lit(None).cast("map<string,string>")
    extension = F.get(F.filter(suffixes, lambda s: F.map_contains_key(known, s)), 0)
    return F.coalesce(F.try_element_at(known, extension), F.lit(OTHER)), extension


def valid_extension(x: Column | str) -> Column:
    """Lower-case letters, digits, ``- + _`` and inner single dots; 64 characters at most."""
    return col(x).rlike(r"^[a-z0-9+_-]+(\.[a-z0-9+_-]+)*$") & (F.length(col(x)) <= 64)


def components(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def depth(path: Column | str) -> Column:
    return F.size(components(path))


def parent(path: Column | str) -> Column:
    """The directory a path lies in; empty for the top."""
    return F.regexp_replace(col(path), r"(^|/)[^/]*$", "")


def ancestors(path: Column | str) -> Column:
    """All directories above a path, from the root (empty) down, the path itself excluded."""
    parts = F.split(col(path), "/")
    return F.when(col(path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``*`` and ``?`` stop at a slash, ``**`` does not."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern == "**":
            out, i = ".*", i + 2
        elif c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{" and (end := pattern.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x)[5:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s)^{out}$"


def path_overlaps(a: Column | str, b: Column | str) -> Column:
    """Whether one path is the other, or lies below it, by whole components."""
    x, y = components(a), components(b)
    n = F.least(F.size(x), F.size(y))
    return F.when(n == 0, F.lit(True)).otherwise(F.slice(x, 1, F.greatest(n, F.lit(1))) == F.slice(y, 1, F.greatest(n, F.lit(1))))


def display_path(raw: Column | str) -> Column:
    """Raw bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(col(raw).cast("string"))


def encoding_warning(raw: Column | str) -> Column:
    return ~F.is_valid_utf8(col(raw).cast("string"))


def raw_key(raw: Column | str) -> Column:
    return F.lower(F.hex(col(raw)))


# --- digests -----------------------------------------------------------------------------------

#: A text is sampled at head, middle and tail beyond the threshold.
SAMPLE_REGION = 64 * 1024
SAMPLE_THRESHOLD = 3 * SAMPLE_REGION
HASH_VERSION = 1


def content_sha256(content: Column | str) -> Column:
    return F.sha2(col(content).cast("binary"), 256)


def _le64(x: Column) -> Column:
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(16), F.lit(2), F.lit(-2)), lambda i: F.substr(F.lpad(F.hex(x), 16, "0"), i - 1, F.lit(2))), ""))


def _le32(x: int) -> Column:
    return F.unhex(F.lit(x.to_bytes(4, "little").hex()))


def sample_fingerprint(content: Column | str, *, region: int = SAMPLE_REGION, threshold: int = SAMPLE_THRESHOLD) -> Column:
    """SHA-256 over version, size and three regions; null up to the threshold."""
    raw = col(content).cast("binary")
    size = F.octet_length(raw).cast("long")
    parts = [_le32(HASH_VERSION), _le64(size)]
    for offset in (F.lit(0).cast("long"), F.floor(size / 2) - region // 2, size - region):
        offset = offset.cast("long")
        parts += [_le64(offset), _le64(F.lit(region).cast("long")), F.substr(raw, (offset + 1).cast("int"), F.lit(region))]
    return F.when(size > threshold, F.sha2(F.concat(*parts), 256))


def candidate_key(size: Column, name: Column | None = None, mtime: tuple[Column, Column] | None = None) -> Column:
    """``size:N``, with the name's hex and the modification time where these narrow the candidates."""
    parts = [F.concat(F.lit("size:"), size.cast("string"))]
    if name is not None:
        parts.append(F.concat(F.lit("name:"), F.lower(F.hex(name))))
    if mtime is not None:
        parts.append(F.concat(F.lit("mtime:"), mtime[0].cast("string"), F.lit("."), mtime[1].cast("string")))
    return F.concat_ws("|", *parts)


def fingerprint(*values: Column | str) -> Column:
    """SHA-256 of the JSON of named values."""
    return F.sha2(F.to_json(F.struct(*values)), 256)


# --- capacity and time -------------------------------------------------------------------------


def capacity_is_consistent(total: Column, free: Column, available: Column) -> Column:
    return (free <= total) & (available <= free)


def bytes_of_blocks(blocks: Column | str, block_size: Column | str) -> Column:
    """Exact product, in 38 digits: more than two unsigned 64-bit numbers of this kind ever need."""
    return col(blocks).cast("decimal(20,0)") * col(block_size).cast("decimal(18,0)")


def minute_floor(ts: Column | str) -> Column:
    return F.date_trunc("minute", col(ts))


def minute_ceil(ts: Column | str) -> Column:
    return F.date_trunc("minute", col(ts) + F.expr("interval 1 minute") - F.expr("interval 1 microsecond"))


def retry_delay_minutes(attempt: Column | str) -> Column:
    """1, 5 and 30 minutes after the first, second and third failure; then none."""
    return F.when(col(attempt) == 1, 1).when(col(attempt) == 2, 5).when(col(attempt) == 3, 30)


def numeric_order(x: Column | str) -> Column:
    """Decimal digits as a number to sort by, of up to 38 places."""
    return col(x).cast("decimal(38,0)")


# --- presentation ------------------------------------------------------------------------------


def guard_formula(x: Column | str) -> Column:
    """A leading apostrophe where a spreadsheet would take the text for a formula."""
    x = col(x)
    return F.when(F.regexp_replace(x, r"^[\p{IsWhite_Space}]+", "").rlike(r"^[=+\-@\x00-\x1f\x7f]"), F.concat(F.lit("'"), x)).otherwise(x)


def csv_field(x: Column | str) -> Column:
    x = col(x)
    return F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column | str) -> Column:
    x = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def export_time(sec: Column | str, nsec: Column | str) -> Column:
    return F.when(col(sec).isNotNull(), F.format_string("%d.%09dZ", col(sec), F.coalesce(col(nsec), F.lit(0))))


def format_bytes(n: Column | str) -> Column:
    """1024-based, cut (not rounded) to two places."""
    n = col(n).cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        base = 1 << (10 * power)
        cents = F.floor((n % base) * 100 / base)
        out = F.when(n >= base, F.concat(F.floor(n / base).cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"), F.lit(f" {unit}"))).otherwise(out)
    return out


def usage_percent(used: Column | str, total: Column | str) -> Column:
    """Percent, cut to hundredths; null without a total."""
    return F.when(col(total) > 0, F.floor(col(used).cast("decimal(38,0)") * 10000 / col(total)).cast("long") / 100)


def hash_cache_key(epoch: Column, device: Column, inode: Column, size: Column, mtime: tuple[Column, Column], ctime: tuple[Column, Column]) -> Column:
    """The key under which a file's digest may be used again (a fixed form): never by inode or path alone; null if any part is unknown."""
    parts = [epoch, device, inode, size, *mtime, *ctime]
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(known, F.format_string("e%d:d%d:i%d:s%d:m%d.%d:c%d.%d:sha256v" + str(HASH_VERSION), *parts))


def scope_fingerprint(scope_json: str, sources: DataFrame) -> DataFrame:
    """One row, fingerprint: SHA-256 of the scope's JSON and of every source by id: id, root, epoch (8 bytes, little-endian), availability."""
    part = F.concat(F.col("source_id").cast("binary"), F.col("root").cast("binary"), _le64(F.col("epoch")), F.col("availability").cast("binary"))
    parts = sources.agg(F.array_sort(F.collect_list(F.struct("source_id", F.hex(part).alias("part")))).alias("parts"))  # sources of a profile: few
    text = F.concat(F.lit(scope_json.encode().hex().upper()), F.array_join(F.transform("parts", lambda x: x["part"]), ""))
    return parts.select(F.sha2(F.unhex(text), 256).alias("fingerprint"))


# --- secrets -----------------------------------------------------------------------------------

#: A JSON key that contains one of these has its value hidden, and what is shown instead.
HIDDEN_KEY_PARTS = ("password", "token", "secret", "smtp_pass", "master_key", "session")
HIDDEN = "<redacted>"


def without_secrets(x: Column | str) -> Column:
    """JSON text in which every value under a key with a part of HIDDEN_KEY_PARTS, in upper or lower case, is HIDDEN.

    The value goes whole, whatever it holds; keys at any depth count, also in lists; of equal keys the last
    stays; null, and text that is not JSON, gives null. JSON nests without bound, which column expressions cannot
    follow: the one function here in Python, as a hook that the parser calls for each object it closes.
    """
    import json

    def closed(pairs: list[tuple]) -> dict:
        keys = [k.casefold() for k, _ in pairs]
        return {k: HIDDEN if any(part in low for part in HIDDEN_KEY_PARTS) else v for low, (k, v) in zip(keys, pairs)}

    def shown(text):
        try:
            return None if text is None else json.dumps(json.loads(text, object_pairs_hook=closed), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def hide(s):
        return s.map(shown)

    return hide(col(x))
