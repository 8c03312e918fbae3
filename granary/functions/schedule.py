"""Occurrences of five-field cron schedules in a time zone."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_NAMES = {n: i for i, n in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))} | {n: i + 1 for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Occurrences that a task remembers of the schedules it has expanded, and those it hands on together, each up to one schedule more.
REMEMBERED = 500_000
TOGETHER = 100_000


def parse_cron(expression: str) -> list[set[int]]:
    """The allowed values of minute, hour, day, month and weekday (0 is Sunday, and so is 7)."""
    fields = expression.lower().split()
    if len(fields) != 5:
        raise ValueError(f"five fields are needed: {expression!r}")
    out = []
    for text, (low, high) in zip(fields, _RANGES):
        values: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span == "*":
                a, b = low, high
            else:
                ends = [_NAMES[x] if x in _NAMES else int(x) for x in span.split("-")]
                a, b = ends[0], ends[-1] if len(ends) > 1 or not step else high
            if not low <= a <= high or not low <= b <= high or a > b:
                raise ValueError(f"out of range: {part!r}")
            values |= set(range(a, b + 1, int(step) if step else 1))
        out.append(values)
    out[4] = {v % 7 for v in out[4]}
    return out


def occurrences(expression: str, zone: str, start: datetime, end: datetime) -> list[tuple[datetime | None, str, bool]]:
    """(instant, local wall time, skipped) of each occurrence in (start, end].

    A wall time that a clock change leaves out is recorded as skipped; one that comes twice fires once, the first time.
    """
    minute, hour, day, month, weekday = parse_cron(expression)
    times = [timedelta(hours=h, minutes=m) for h in sorted(hour) for m in sorted(minute)]
    tz, out = ZoneInfo(zone), []
    date = start.astimezone(tz).replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0) - timedelta(days=1)
    last = end.astimezone(tz).replace(tzinfo=None) + timedelta(days=1)
    while date <= last:
        if date.month in month and date.day in day and (date.weekday() + 1) % 7 in weekday:
            for local in (date + t for t in times):
                instant = local.replace(tzinfo=tz, fold=0).astimezone(UTC)
                if start < instant <= end:
                    real = instant.astimezone(tz).replace(tzinfo=None) == local
                    out.append((instant if real else None, local.strftime("%Y-%m-%dT%H:%M"), not real))
        date += timedelta(days=1)
    return out


def _columns(found: list[tuple[datetime | None, str, bool]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in ((1, pa.string()), (0, pa.timestamp("us", "UTC")), (2, pa.bool_()))], ["occurrence_key", "planned_at", "skipped_nonexistent"])


def _expanded(batches: Iterator[pa.RecordBatch], start: datetime, end: datetime) -> Iterator[pa.RecordBatch]:
    """Rows of profiles (profile_id, cron, zone) with each occurrence of their schedules."""
    known: dict[tuple[str, str], pa.RecordBatch] = {}
    n_known = 0

    def dealt(ids: pa.Array, which: list[int], used: list[pa.RecordBatch]) -> pa.RecordBatch:
        size = np.array([x.num_rows for x in used])
        n = size[which]
        at = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = pa.concat_batches(used).take(pa.array(at))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), *rows.columns], ["profile_id", *rows.schema.names])

    for b in batches:
        order: dict[tuple[str, str], int] = {}
        which: list[int] = []
        used: list[pa.RecordBatch] = []
        first, n = 0, 0
        for k, schedule in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            place = order.get(schedule)
            if place is None:
                if schedule not in known:
                    if n_known > REMEMBERED:
                        known.clear()
                        n_known = 0
                    known[schedule] = _columns(occurrences(*schedule, start, end))
                    n_known += 1 + known[schedule].num_rows
                place = order[schedule] = len(used)
                used.append(known[schedule])
            which.append(place)
            n += used[place].num_rows
            if n >= TOGETHER:
                yield dealt(b.column(0)[first : k + 1], which, used)
                order, which, used, first, n = {}, [], [], k + 1, 0
        if which:
            yield dealt(b.column(0)[first:], which, used)


def occurrence_table(profiles: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Occurrences of schedules (profile_id, cron, zone), expanded in the tasks that hold the profiles.

    A task expands a schedule that several profiles have once, as long as it is remembered, and copies it to each.
    """
    return profiles.select("profile_id", "cron", "zone").mapInArrow(lambda batches: _expanded(batches, start, end), "profile_id string, occurrence_key string, planned_at timestamp, skipped_nonexistent boolean")
