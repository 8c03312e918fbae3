"""Relational logic around reports: quotas, retention, job logs, queues, imports, occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- quotas ----------------------------------------------------------------------------------

QUOTA_KEYS = ["principal_namespace", "principal_uid", "scope_kind", "scope_id", "metric"]


def origin_rank(origin: Column) -> Column:
    """Fixed order of origins."""
    return F.when(origin == "system_imported", 0).when(origin == "advisory", 1).when(origin == "unknown", 2).otherwise(3)


def stale(now, expires: Column) -> Column:
    return F.coalesce(expires <= F.lit(now).cast("timestamp"), F.lit(False))


def effective_quotas(records: DataFrame, now) -> DataFrame:
    """One record for each principal, scope and metric: fresh before stale, then newest, best origin, highest id.

    ``max_by`` over an ordering struct: partial aggregation, so a principal with very many records is no hot task.
    """
    flagged = records.withColumn("stale", stale(now, F.col("expires_at")))
    order = F.struct((~F.col("stale")).alias("a"), F.col("observed_at").alias("b"), (-origin_rank(F.col("origin"))).alias("c"), F.col("id").alias("d"))
    rest = [c for c in flagged.columns if c not in QUOTA_KEYS]
    return flagged.groupBy(*QUOTA_KEYS).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*QUOTA_KEYS, "r.*")


def display_owner(rows: DataFrame, mappings: DataFrame, namespace: str) -> DataFrame:
    """Adds owner_name: the mapped name, else ``uid:N``."""
    names = mappings.filter(F.col("namespace") == namespace).groupBy("uid").agg(F.min("display_name").alias("mapped"))
    return rows.join(names, "uid", "left").withColumn("owner_name", F.coalesce("mapped", F.concat(F.lit("uid:"), F.col("uid").cast("string")))).drop("mapped")


def import_problems(records: DataFrame, known_scopes: DataFrame, now) -> DataFrame:
    """Findings of a metadata import: id, problem, severity."""
    limit = F.col("limit_bytes").cast("decimal(20,0)")
    checks = {
        "zero_limit": ("warning", (F.col("limit_state") == "known") & (limit == 0)),
        "limit_bytes": ("error", ((F.col("limit_state") == "known") & limit.isNull()) | ((F.col("limit_state") != "known") & limit.isNotNull())),
        "stale_in_file": ("warning", stale(now, F.col("expires_at"))),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("problem"), F.lit(s).alias("severity"))) for name, (s, c) in checks.items())))
    own = records.select("id", F.explode(found).alias("f")).select("id", "f.*")
    unknown = records.join(known_scopes.select("scope_id").distinct(), "scope_id", "left_anti").select("id", F.lit("unknown_scope").alias("problem"), F.lit("error").alias("severity"))
    names = records.groupBy("principal_namespace", "principal_uid").agg(F.min("provider_label").alias("a"), F.max("provider_label").alias("b"), F.min("id").alias("id")).filter("a <> b")
    return own.unionByName(unknown).unionByName(names.select("id", F.lit("conflicting_display_name").alias("problem"), F.lit("warning").alias("severity")))


def import_summary(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows an import adds and updates."""
    known = existing.select(*keys).distinct().withColumn("known", F.lit(True))
    j = incoming.join(known, keys, "left")
    return j.agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("updated"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of equal keys."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows stay; of new keys the first row by ``order`` is added."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return existing.unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti").select(existing.columns))


# --- retention -------------------------------------------------------------------------------


def beyond_newest(reports: DataFrame, keep: int, pinned: Column) -> DataFrame:
    """Reports past the newest ``keep`` of their profile; pinned ones are neither counted nor returned. A null profile is one of its own."""
    w = Window.partitionBy("profile_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return reports.filter(~pinned).withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") > keep)


def retention_plan(reports: DataFrame, keep_reports: int, keep_details: int) -> DataFrame:
    """For each report: whether it goes, and whether its details go; the two counts are independent."""
    gone = beyond_newest(reports, keep_reports, F.col("pinned")).select("id", F.lit(True).alias("remove_report"))
    thin = beyond_newest(reports.filter("detail_available"), keep_details, F.col("detail_pinned") | F.col("pinned")).select("id", F.lit(True).alias("remove_detail"))
    j = reports.select("id", "profile_id").join(gone, "id", "left").join(thin, "id", "left")
    return j.select("id", "profile_id", F.coalesce("remove_report", F.lit(False)).alias("remove_report"), F.coalesce("remove_detail", F.lit(False)).alias("remove_detail"))


def latest_events(events: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest events of each job, by sequence: the job's highest sequence decides, from a partial aggregation."""
    top = events.groupBy("job_id").agg(F.max("sequence").alias("top"))
    return events.join(top, "job_id").filter(F.col("sequence") > F.col("top") - keep).drop("top")


def events_after(events: DataFrame, job_id, sequence: int, limit: int = 1000) -> DataFrame:
    return events.filter((F.col("job_id") == job_id) & (F.col("sequence") > sequence)).orderBy("sequence").limit(limit)


def next_sequence(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg((F.max("sequence") + 1).alias("next_sequence"))


def error_log(errors: DataFrame, cap: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The first errors by id, and the count of all."""
    return errors.orderBy("error_id").limit(cap), errors.agg(F.count(F.lit(1)).alias("errors"))


# --- jobs ------------------------------------------------------------------------------------

#: The legal transitions of a job.
TRANSITIONS = {
    "QUEUED": ("RUNNING", "CANCELLING"),
    "RUNNING": ("PAUSING", "SUCCEEDED", "PARTIAL", "FAILED", "CANCELLING"),
    "PAUSING": ("PAUSED", "CANCELLING"),
    "PAUSED": ("RUNNING", "CANCELLING"),
    "CANCELLING": ("CANCELLED",),
}
ACTIVE = ("RUNNING", "PAUSING", "PAUSED", "CANCELLING")


def legal(source: Column, target: Column) -> Column:
    """Whether a job may go from one state to another; states without transitions are final."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs))
    return F.array_contains(pairs, F.concat_ws(">", source, target))


def counts_by_state(jobs: DataFrame, states: tuple[str, ...]) -> DataFrame:
    return jobs.agg(*(F.count_if(F.col("state") == s).alias(s.lower()) for s in states))


def queue_head(jobs: DataFrame, state: str = "QUEUED") -> DataFrame:
    """The oldest waiting job."""
    return jobs.filter(F.col("state") == state).orderBy("created_at", "id").limit(1)


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("state", F.when(F.col("state").isin(*ACTIVE), "INTERRUPTED").otherwise(F.col("state")))


def outbox_claim(outbox: DataFrame, now, limit: int = 20, lease_minutes: int = 5) -> DataFrame:
    """Due messages, oldest first, with the lease they get; claimed ones come back when the lease has run out."""
    at = F.lit(now).cast("timestamp")
    due = ((F.col("state") == "pending") & (F.col("next_attempt_at") <= at)) | ((F.col("state") == "sending") & (F.col("lease_until") <= at))
    return outbox.filter(due).orderBy("next_attempt_at", "id").limit(limit).withColumn("lease_until", at + F.expr(f"interval {int(lease_minutes)} minutes")).withColumn("state", F.lit("sending"))


def outbox_failed(outbox: DataFrame, now) -> DataFrame:
    """State after a failed attempt: retried after 1, 5 and 30 minutes, then given up."""
    from granary.functions.expressions import retry_delay_minutes

    n = F.col("attempts") + 1
    delay = retry_delay_minutes(n)
    return outbox.withColumn("state", F.when(delay.isNull(), "failed").otherwise("pending")).withColumn("next_attempt_at", F.lit(now).cast("timestamp") + F.make_interval(mins=F.coalesce(delay, F.lit(0)))).withColumn("attempts", n)


def due_purges(items: DataFrame, plans: DataFrame, sources: DataFrame, jobs: DataFrame, before, limit: int = 100) -> DataFrame:
    """Quarantined items past their time whose purge no job has taken yet: jobs name item and plan in JSON."""
    named = jobs.select(F.get_json_object("params_json", "$.item_id").cast("long").alias("item_id"), F.get_json_object("params_json", "$.plan_id").cast("long").alias("plan_id")).distinct()
    j = items.join(plans, "plan_id").join(sources, "source_id").filter(F.col("quarantined_at") <= F.lit(before).cast("timestamp"))
    return j.join(named, ["item_id", "plan_id"], "left_anti").orderBy("quarantined_at", "item_id").limit(limit)


def profile_sources(profile: dict, sources: DataFrame) -> DataFrame:
    """The sources a profile covers: those named, or all that are not younger than it (or all, if it takes future ones)."""
    if profile.get("sources") != "all":
        return sources.filter(F.col("source_id").isin(*profile["sources"]))
    return sources if profile.get("include_future") else sources.filter(F.col("created_at") <= F.lit(profile["created_at"]).cast("timestamp"))


def listing(rows: DataFrame, filters: dict, last: tuple | None = None, limit: int = 50) -> DataFrame:
    """Newest first by (created_at, id), after the last row of the page before; only filters that are set apply."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if last is not None:
        at, key = F.lit(last[0]).cast(rows.schema["created_at"].dataType), F.lit(last[1])
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < key)))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """One row for each profile and local wall time: the earliest instant."""
    return occurrences.groupBy("profile_id", "occurrence_key").agg(F.min("planned_at").alias("planned_at"))


def misfires(occurrences: DataFrame, now, window_hours: int = 6) -> DataFrame:
    """For each profile the latest missed occurrence that is at most ``window_hours`` old."""
    at = F.lit(now).cast("timestamp")
    latest = occurrences.filter((F.col("planned_at") <= at) & ~F.col("skipped_nonexistent")).groupBy("profile_id").agg(F.max("planned_at").alias("planned_at"))
    return latest.filter(F.col("planned_at") >= at - F.expr(f"interval {int(window_hours)} hours"))


def occurrence_listing(occurrences: DataFrame, limit: int = 50) -> DataFrame:
    """Occurrences, latest first: by the planned instant, or the local wall time where there is none; then by key. 1 to 1000 rows, with their place."""
    order = [F.coalesce("planned_at", "planned_local_at").desc(), F.col("occurrence_key").desc()]
    top = occurrences.orderBy(*order).limit(min(max(limit, 1), 1000))
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
