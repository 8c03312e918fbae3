"""Filtered, sorted and paged queries over files, folders, owners and categories."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = ("name", "size", "allocated", "mtime", "atime", "category", "owner")
#: Filters that each section of a report takes.
SECTION_FILTERS = {
    "files": {"source_ids", "category_ids", "extensions", "owner_uids", "name_contains", "min_size_bytes", "max_size_bytes", "mtime_from", "mtime_to", "atime_from", "atime_to", "directory"},
    "folders": {"source_ids", "name_contains", "min_size_bytes", "max_size_bytes", "directory"},
    "owners": {"source_ids", "category_ids", "owner_uids"},
    "categories": {"source_ids", "category_ids", "extensions", "owner_uids", "directory"},
    "largest": {"source_ids", "category_ids", "extensions", "owner_uids", "name_contains", "min_size_bytes", "max_size_bytes", "mtime_from", "mtime_to", "atime_from", "atime_to"},
    "duplicates": {"source_ids", "min_size_bytes", "max_size_bytes"},
    "volume": set(),
    "quota": {"owner_uids"},
}
SECTION_FILTERS |= {k: SECTION_FILTERS["largest"] for k in ("recently_modified", "least_accessed")}


@dataclass(frozen=True)
class QuerySpec:
    """A query as a value: equal queries have equal canonical forms and hashes."""

    source_ids: tuple[str, ...] = ()
    category_ids: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    owner_uids: tuple[int, ...] = ()
    name_contains: str | None = None
    min_size_bytes: str | None = None
    max_size_bytes: str | None = None
    mtime_from: str | None = None
    mtime_to: str | None = None
    atime_from: str | None = None
    atime_to: str | None = None
    directory: str | None = None
    sort: str = "size"
    descending: bool = True

    def canonical(self) -> QuerySpec:
        """Sets sorted, extensions lower-cased, numbers without leading zeros, times in UTC; ValueError if it contradicts itself."""

        def number(x):
            if x is not None and not str(x).isdigit():
                raise ValueError(f"not a decimal number: {x!r}")
            return None if x is None else str(int(x))

        def when(x):
            if x is None:
                return None
            t = datetime.fromisoformat(x)
            if t.tzinfo is None:
                raise ValueError(f"a time needs an offset: {x!r}")
            return t.astimezone(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")

        if self.sort not in SORTS:
            raise ValueError(f"no such sort: {self.sort!r}")
        out = replace(
            self, source_ids=tuple(sorted(set(self.source_ids))), category_ids=tuple(sorted(set(self.category_ids))),
            extensions=tuple(sorted({e.lower() if e.isascii() else e for e in self.extensions})), owner_uids=tuple(sorted(set(self.owner_uids))),
            min_size_bytes=number(self.min_size_bytes), max_size_bytes=number(self.max_size_bytes),
            mtime_from=when(self.mtime_from), mtime_to=when(self.mtime_to), atime_from=when(self.atime_from), atime_to=when(self.atime_to),
        )
        if out.min_size_bytes and out.max_size_bytes and int(out.min_size_bytes) > int(out.max_size_bytes):
            raise ValueError("min_size_bytes is over max_size_bytes")
        for a, b in (("mtime_from", "mtime_to"), ("atime_from", "atime_to")):
            if getattr(out, a) and getattr(out, b) and getattr(out, a) >= getattr(out, b):
                raise ValueError(f"{a} is not before {b}")
        return out

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self.canonical()), sort_keys=True).encode()).hexdigest()

    def scoped(self, scope: str) -> QuerySpec:
        """``current`` keeps the query, ``all`` is the default one."""
        return {"current": self, "all": QuerySpec()}[scope]

    def check_section(self, section: str) -> QuerySpec:
        """ValueError if the section can't apply a filter that is set."""
        default, taken = QuerySpec(), SECTION_FILTERS[section] | {"sort", "descending"}
        for name, value in asdict(self).items():
            if value != getattr(default, name) and name not in taken:
                raise ValueError(f"{section} does not take {name}")
        return self

    def predicates(self) -> list[Column]:
        """One for each filter that is set; an empty set filters nothing, a null value never matches."""
        q, out = self.canonical(), []
        for name, column in (("source_ids", "source_id"), ("category_ids", "category_id"), ("extensions", "extension"), ("owner_uids", "uid")):
            if values := getattr(q, name):
                out.append(F.col(column).isin(*values))
        if q.name_contains:
            out.append(F.instr("display_name", q.name_contains) > 0)
        if q.min_size_bytes:
            out.append(F.col("size_bytes") >= int(q.min_size_bytes))
        if q.max_size_bytes:
            out.append(F.col("size_bytes") <= int(q.max_size_bytes))
        for name in ("mtime", "atime"):
            for end, before in (("from", False), ("to", True)):
                if t := getattr(q, f"{name}_{end}"):
                    out.append(time_bound(name, datetime.fromisoformat(t), before))
        return out


def time_bound(name: str, t: datetime, before: bool) -> Column:
    """(sec, nsec) at or after a time, or before it: half-open, by whole nanoseconds."""
    sec, nsec = int(t.timestamp() // 1), t.microsecond * 1000
    s, n = F.col(f"{name}_sec"), F.coalesce(F.col(f"{name}_nsec"), F.lit(0))
    return (s < sec) | ((s == sec) & (n < nsec)) if before else (s > sec) | ((s == sec) & (n >= nsec))


def subtree(rows: DataFrame, source_id: str, directory: str, path: str = "path") -> DataFrame:
    """A directory of a source and all that lies below it: a prefix of the path, which the scan can use."""
    inside = F.lit(True) if directory == "" else (F.col(path) == directory) | F.col(path).startswith(directory + "/")
    return rows.filter((F.col("source_id") == source_id) & inside)


def direct_children(rows: DataFrame, source_id: str, directory: str) -> DataFrame:
    from granary.functions.expressions import parent

    return rows.filter((F.col("source_id") == source_id) & (parent("path") == directory) & (F.col("path") != ""))


def find(files: DataFrame, spec: QuerySpec) -> DataFrame:
    """The files a query selects, unsorted."""
    rows = reduce(lambda d, p: d.filter(p), spec.predicates(), files.filter(F.col("entry_kind") == "regular_file"))
    if spec.directory is not None:
        source = spec.source_ids[0] if len(spec.source_ids) == 1 else None
        if source is None:
            raise ValueError("a directory is looked up in one source")
        rows = subtree(rows, source, spec.directory)
    return rows


_KEYS = {"name": ["display_name"], "size": ["size_bytes"], "allocated": ["allocated_bytes_estimate"], "mtime": ["mtime_sec", "mtime_nsec"], "atime": ["atime_sec", "atime_nsec"], "category": ["category_id"], "owner": ["uid"]}


@dataclass(frozen=True)
class Order:
    """A total order: keys with directions, nulls first or last, and entry_id to break ties."""

    keys: tuple[str, ...]
    descending: bool = False
    nulls_last: bool = False
    tie: tuple[str, ...] = ("entry_id",)

    def columns(self) -> list[Column]:
        def way(k):
            c = F.col(k)
            if self.descending:  # nulls are smallest, and so last
                return c.desc_nulls_last()
            return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

        return [*map(way, self.keys), *(F.col(k).asc() for k in self.tie)]

    def after(self, last: dict) -> Column:
        """Rows that come strictly after a row with these values, nulls included."""
        null_is_last = self.descending or self.nulls_last
        out, equal = F.lit(False), F.lit(True)
        for k in self.keys:
            c, v = F.col(k), last[k]
            if v is None:
                beyond = F.lit(False) if null_is_last else c.isNotNull()
            else:
                beyond = c < F.lit(v) if self.descending else c > F.lit(v)
                beyond = F.coalesce(beyond, F.lit(null_is_last))
            out, equal = out | (equal & beyond), equal & c.eqNullSafe(F.lit(v))
        for k in self.tie:
            out, equal = out | (equal & (F.col(k) > F.lit(last[k]))), equal & (F.col(k) == F.lit(last[k]))
        return out


def order_of(spec: QuerySpec) -> Order:
    """File sorts: nulls are smallest, in either direction."""
    return Order(tuple(_KEYS[spec.sort]), spec.descending)


def metric_order(metric: str, descending: bool, tie: tuple[str, ...] = ("entry_id",)) -> Order:
    """Folder and category sorts: nulls last in either direction."""
    return Order((metric,), descending, True, tie)


#: Least, most and default of what a caller may ask for: rows of a page, ranks of a ranking, listed members of a group.
LIMITS = {"page": (1, 200, 50), "rank": (1, 10_000, 200), "listed": (1, 100_000, 1000)}


def clamped(kind: str, asked: int | None) -> int:
    """What is asked for, cut to its limits; the default where nothing is."""
    least, most, default = LIMITS[kind]
    return default if asked is None else min(max(asked, least), most)


def page_size(asked: int | None, *, strict: bool = False) -> int:
    """50 by default, 1 to 200: cut to the range, or refused outside it."""
    if strict and asked is not None and clamped("page", asked) != asked:
        raise ValueError("a page has 1 to 200 rows")
    return clamped("page", asked)


@dataclass
class Cursor:
    """A signed place in a result: bound to its report, query and order."""

    report_id: str
    query_hash: str
    last: dict = field(default_factory=dict)

    def sign(self, key: bytes) -> str:
        body = json.dumps(asdict(self), sort_keys=True, default=str).encode()
        return base64.urlsafe_b64encode(hmac.digest(key, body, "sha256") + body).decode()

    @staticmethod
    def read(token: str, key: bytes, report_id: str, query_hash: str) -> Cursor:
        raw = base64.urlsafe_b64decode(token)
        if not hmac.compare_digest(raw[:32], hmac.digest(key, raw[32:], "sha256")):
            raise ValueError("the cursor was not made here")
        out = Cursor(**json.loads(raw[32:]))
        if (out.report_id, out.query_hash) != (report_id, query_hash):
            raise ValueError("the cursor belongs to another result")
        return out


def page(rows: DataFrame, order: Order, size: int, last: dict | None = None) -> tuple[list, dict | None]:
    """One page and the values of its last row (None at the end): pages join up to the whole result."""
    found = (rows if last is None else rows.filter(order.after(last))).orderBy(*order.columns()).limit(size + 1).collect()
    shown = found[:size]
    return shown, ({k: shown[-1][k] for k in (*order.keys, *order.tie)} if len(found) > size else None)
