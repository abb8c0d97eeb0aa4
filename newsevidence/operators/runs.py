"""Due endpoints, endpoint attempts and their state, run roll-ups and run maintenance."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import REASON_BLOCKED, REASON_EXTRACTION, REASON_ROBOTS
from .keyed import salted_join

# Thresholds, messages and the failures a run roll-up overlooks.
BLOCK_THRESHOLD = 2
BLOCK_HOURS = 24
RUN_TIMEOUT = timedelta(hours=6)
MAX_RUN_TIMEOUT = timedelta(hours=24)
STALE_MESSAGE = "Run exceeded timeout and was marked stale/FAILED"
NOT_DISPATCHED = "Enqueue failed before dispatch: "
ROBOTS_SOURCE = "Robots.txt disallows scraping for this source"
ROBOTS_SAMPLE = "Robots.txt disallows scraping for "
BLOCKED_UNTIL = "Source blocked until "
IGNORED_FAILURES = [
    "robots.txt disallows",
    "source blocked until",
    "too many chunks for embedding",
    "too many texts in one request",
    "unprocessable entity",
    "nlp embed failed",
]
STOP_REASONS = [REASON_ROBOTS, REASON_BLOCKED]


def eligible_endpoints(endpoints: DataFrame, now: Column, endpoint_id: int | None = None) -> DataFrame:
    """Enabled, not blocked at ``now``, and never fetched or fetched longer ago than their interval."""
    due = F.col("last_fetched_at").isNull() | (
        F.col("last_fetched_at") < now - F.make_dt_interval(mins=F.col("fetch_interval_minutes"))
    )
    free = F.col("blocked_until").isNull() | (F.col("blocked_until") < now)
    out = endpoints.filter(F.col("enabled") & free & due)
    return out if endpoint_id is None else out.filter(F.col("id") == endpoint_id)


# State predicates of the catalog and run tables; each is a plain filter that reaches the scan.
def enabled_of_kind(endpoints: DataFrame, kind: str) -> DataFrame:
    return endpoints.filter(F.col("enabled") & (F.col("kind") == kind))


def articles_in(articles: DataFrame, status: str, publisher_id: int | None = None) -> DataFrame:
    out = articles.filter(F.col("status") == status)
    return out if publisher_id is None else out.filter(F.col("publisher_id") == publisher_id)


def unmapped_publishers(publishers: DataFrame) -> DataFrame:
    return publishers.filter(F.col("rating_id").isNull())


def pending_logs(logs: DataFrame, run_id: int | None = None) -> DataFrame:
    out = logs.filter(F.col("completed_at").isNull())
    return out if run_id is None else out.filter(F.col("run_id") == run_id)


def runs_before(runs: DataFrame, status: str, cutoff: Column) -> DataFrame:
    return runs.filter((F.col("status") == status) & (F.col("started_at") < cutoff))


def stop_at_signal(items: DataFrame, keys: tuple[str, ...] = ("run_id", "endpoint_id"), pos: str = "pos",
                   reason: str = "reason") -> DataFrame:
    """Items that count: feed order, up to and including the first robots or block signal.

    The first signal per endpoint is an aggregate joined back with salted keys, so an endpoint that
    holds a large share of all items is neither one window partition nor one join task.
    """
    counted = items.filter(~F.col("skipped") & F.col("is_new"))
    stop = F.min(F.when(F.col(reason).isin(STOP_REASONS), F.col(pos))).alias("_stop")
    stops = counted.groupBy(*keys).agg(stop)
    joined = salted_join(counted, stops, keys, [*keys, pos], "inner")
    return joined.filter(F.col("_stop").isNull() | (F.col(pos) <= F.col("_stop"))).drop("_stop")


def item_counts(items: DataFrame, keys: tuple[str, ...] = ("run_id", "endpoint_id")) -> DataFrame:
    """Per attempt: processed, failed, whether a text was won, and the block reason that stands.

    A counted item has ``success`` (text won) and ``indexed``. A stop signal outranks extraction failures.
    """
    kept = stop_at_signal(items, keys)
    done = F.col("success") & F.col("indexed")
    reason = lambda r: F.max(F.when(F.col("reason") == r, F.lit(r)))
    return kept.groupBy(*keys).agg(
        F.count(F.when(done, 1)).alias("processed"),
        F.count(F.when(~done, 1)).alias("failed"),
        F.max("success").alias("had_success"),
        F.coalesce(reason(REASON_ROBOTS), reason(REASON_BLOCKED), reason(REASON_EXTRACTION)).alias("reason"),
    )


def worked_endpoints(fetches: DataFrame, endpoints: DataFrame, now: Column) -> DataFrame:
    """``(endpoint_id)`` whose attempt gets to its items: no flag, block or fetch error, sample URL not barred."""
    state = endpoints.select(F.col("id").alias("endpoint_id"), "robots_disallowed", "blocked_until")
    free = ~F.coalesce("robots_disallowed", F.lit(False)) & ~F.coalesce(F.col("blocked_until") > now, F.lit(False))
    sampled = F.col("sample_url").isNull() | F.coalesce("sample_allowed", F.lit(True))
    return fetches.join(state, "endpoint_id").filter(free & F.col("fetch_error").isNull() & sampled).select("endpoint_id").distinct()


def first_stops(items: DataFrame, keys: tuple[str, ...], pos: str = "pos", reason: str = "reason") -> DataFrame:
    """Per key the place of the first robots or block signal, where there is one."""
    return items.filter(F.col(reason).isin(STOP_REASONS)).groupBy(*keys).agg(F.min(pos).alias("stop"))


def endpoint_attempt(fetches: DataFrame, endpoints: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """One row per (run, endpoint) attempt with its status and counts.

    ``fetches(run_id, endpoint_id, fetched, fetch_error, sample_url, sample_allowed)`` is what was
    landed per attempt. Flags and blocks of the endpoint end an attempt before its items matter.
    """
    state = endpoints.select(F.col("id").alias("endpoint_id"), "robots_disallowed", "blocked_until")
    joined = fetches.join(state, "endpoint_id").join(item_counts(items), ["run_id", "endpoint_id"], "left")
    robots = F.coalesce(F.col("robots_disallowed"), F.lit(False))
    blocked = F.coalesce(F.col("blocked_until") > now, F.lit(False))
    broken = F.col("fetch_error").isNotNull()
    barred = F.col("sample_url").isNotNull() & ~F.coalesce(F.col("sample_allowed"), F.lit(True))
    early = robots | blocked | broken | barred
    count = lambda c: F.when(early, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
    fetched = F.when(robots | blocked | broken, F.lit(0)).otherwise(F.coalesce("fetched", F.lit(0)))
    status = (
        F.when(robots | blocked, F.lit("SKIPPED")).when(broken, F.lit("FAILED")).when(barred, F.lit("SKIPPED"))
        .when(count("failed") == 0, F.lit("SUCCESS")).when(count("processed") > 0, F.lit("PARTIAL"))
        .otherwise(F.lit("FAILED"))
    )
    details = (
        F.when(robots, F.lit(ROBOTS_SOURCE))
        .when(blocked, F.concat(F.lit(BLOCKED_UNTIL), F.date_format("blocked_until", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(broken, F.concat(F.lit("Fetch error: "), F.col("fetch_error")))
        .when(barred, F.concat(F.lit(ROBOTS_SAMPLE), F.col("sample_url")))
    )
    return joined.select(
        "run_id",
        "endpoint_id",
        status.alias("status"),
        details.alias("error_details"),
        fetched.alias("articles_fetched"),
        count("processed").alias("articles_processed"),
        count("failed").alias("articles_failed"),
        (~early).alias("worked"),
        (~(robots | blocked) & broken).alias("fetch_failed"),
        (~(robots | blocked | broken) & barred).alias("sample_barred"),
        (~early & F.coalesce("had_success", F.lit(False))).alias("had_success"),
        F.when(~early, F.col("reason")).alias("reason"),
    )


def update_endpoint_state(endpoints: DataFrame, attempts: DataFrame, now: Column,
                          threshold: int = BLOCK_THRESHOLD, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Endpoint snapshot after one attempt per endpoint.

    A block signal always counts, extraction failures only when nothing succeeded; the block itself
    starts when the counter reaches ``threshold``. A robots signal sets the flag and zeroes the
    block. A success without any signal clears it. With a signal that does not count, nothing changes.
    """
    cols = ["endpoint_id", "status", "worked", "fetch_failed", "sample_barred", "had_success", "reason",
            "articles_failed"]
    a = attempts.select(*[F.col(c).alias(f"_{c}") for c in cols])
    joined = endpoints.join(a, F.col("id") == F.col("_endpoint_id"), "left")
    tried = F.col("_endpoint_id").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = F.col("_reason")
    robots = yes(F.col("_sample_barred")) | yes(reason == REASON_ROBOTS)
    blocking = yes(reason == REASON_BLOCKED) | (yes(reason == REASON_EXTRACTION) & ~yes(F.col("_had_success")))
    clear = yes(F.col("_worked")) & reason.isNull() & yes(F.col("_had_success"))
    count = F.when(robots | clear, F.lit(0)).when(blocking, F.col("block_count") + 1).otherwise(F.col("block_count"))
    until = (
        F.when(robots | clear, F.lit(None).cast("timestamp"))
        .when(blocking & (F.col("block_count") + 1 >= threshold), now + F.make_dt_interval(hours=F.lit(block_hours)))
        .otherwise(F.col("blocked_until"))
    )
    why = (
        F.when(robots, F.lit(REASON_ROBOTS)).when(clear, F.lit(None).cast("string")).when(blocking, reason)
        .otherwise(F.col("block_reason"))
    )
    worked = yes(F.col("_worked"))
    clean = worked & (F.col("_articles_failed") == 0)
    failures = (
        F.when(clean, F.lit(0)).when(worked | yes(F.col("_fetch_failed")), F.col("failure_count") + 1)
        .otherwise(F.col("failure_count"))
    )
    moved = yes(F.col("_sample_barred")) | (worked & F.col("_status").isin("SUCCESS", "PARTIAL"))
    new = {
        "last_attempted_at": F.when(tried, now).otherwise(F.col("last_attempted_at")),
        "last_fetched_at": F.when(moved, now).otherwise(F.col("last_fetched_at")),
        "last_success_at": F.when(clean, now).otherwise(F.col("last_success_at")),
        "failure_count": failures,
        "robots_disallowed": F.col("robots_disallowed") | robots,
        "block_count": count,
        "block_reason": why,
        "blocked_until": until,
        "updated_at": F.when(tried, now).otherwise(F.col("updated_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in endpoints.columns])


def ignored_failure(details) -> Column:
    pattern = "|".join(t.replace(".", r"\.") for t in IGNORED_FAILURES)
    return F.coalesce(F.lower(details).rlike(pattern), F.lit(False))


def run_rollup(logs: DataFrame) -> DataFrame:
    """Final status of every run without a pending log."""
    is_status = lambda s: F.col("status") == s
    totals = logs.groupBy("run_id").agg(
        F.count(F.when(F.col("completed_at").isNull(), 1)).alias("_pending"),
        F.count(F.when(is_status("SUCCESS"), 1)).alias("success_count"),
        F.count(F.when(is_status("PARTIAL"), 1)).alias("partial_count"),
        F.count(F.when(is_status("FAILED") & ~ignored_failure(F.col("error_details")), 1)).alias("failure_count"),
    )
    won, mixed, lost = F.col("success_count"), F.col("partial_count"), F.col("failure_count")
    status = (
        F.when((won == 0) & (mixed == 0), F.lit("FAILED")).when((lost == 0) & (mixed == 0), F.lit("COMPLETED"))
        .otherwise(F.lit("PARTIAL"))
    )
    return totals.filter("_pending = 0").drop("_pending").withColumn("status", status)


def runs_complete(runs: DataFrame, logs: DataFrame, with_failures: bool) -> DataFrame:
    """RUNNING runs without a pending log, with or without a FAILED or PARTIAL one."""
    open_logs = pending_logs(logs).select(F.col("run_id").alias("id"))
    bad = logs.filter(F.col("status").isin("FAILED", "PARTIAL")).select(F.col("run_id").alias("id"))
    settled = runs.filter("status = 'RUNNING'").join(open_logs, "id", "left_anti")
    return settled.join(bad, "id", "left_semi" if with_failures else "left_anti")


def clamp_timeout(timeout: timedelta | None) -> timedelta:
    if timeout is None or timeout <= timedelta(0):
        return RUN_TIMEOUT
    return min(timeout, MAX_RUN_TIMEOUT)


def fail_logs(logs: DataFrame, runs: DataFrame, message: str, now: Column) -> DataFrame:
    """Logs after all pending ones of ``runs(id)`` failed with a message."""
    hit = runs.select(F.col("id").alias("run_id"), F.lit(True).alias("_hit"))
    joined = logs.join(hit, "run_id", "left")
    fail = F.col("_hit").isNotNull() & F.col("completed_at").isNull()
    new = {
        "status": F.when(fail, F.lit("FAILED")).otherwise(F.col("status")),
        "error_details": F.when(fail, F.lit(message)).otherwise(F.col("error_details")),
        "completed_at": F.when(fail, now).otherwise(F.col("completed_at")),
        "version": F.when(fail, F.col("version") + 1).otherwise(F.col("version")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in logs.columns])


def expire_runs(runs: DataFrame, logs: DataFrame, now: Column,
                timeout: timedelta | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs that ran too long become FAILED, and so do their pending logs."""
    cutoff = now - F.make_dt_interval(secs=F.lit(clamp_timeout(timeout).total_seconds()))
    stale = (F.col("status") == "RUNNING") & (F.col("started_at") < cutoff)
    new = {
        "status": F.when(stale, F.lit("FAILED")).otherwise(F.col("status")),
        "completed_at": F.when(stale, now).otherwise(F.col("completed_at")),
        "version": F.when(stale, F.col("version") + 1).otherwise(F.col("version")),
    }
    expired = runs.select(*[new[c].alias(c) if c in new else F.col(c) for c in runs.columns])
    return expired, fail_logs(logs, runs.filter(stale).select("id"), STALE_MESSAGE, now)


def fail_undispatched(logs: DataFrame, planned: DataFrame, dispatched: DataFrame, cause: str,
                      now: Column) -> DataFrame:
    """Pending logs of (run, endpoint) pairs that were planned but never dispatched become FAILED."""
    keys = ["run_id", "source_endpoint_id"]
    lost = planned.join(dispatched, keys, "left_anti").withColumn("_lost", F.lit(True))
    joined = logs.join(lost, keys, "left")
    fail = F.col("_lost").isNotNull() & F.col("completed_at").isNull()
    new = {
        "status": F.when(fail, F.lit("FAILED")).otherwise(F.col("status")),
        "error_details": F.when(fail, F.lit(NOT_DISPATCHED + cause)).otherwise(F.col("error_details")),
        "completed_at": F.when(fail, now).otherwise(F.col("completed_at")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in logs.columns])


def active_run(runs: DataFrame) -> DataFrame:
    """The newest RUNNING run."""
    return runs.filter("status = 'RUNNING'").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def log_view(logs: DataFrame, endpoints: DataFrame, publishers: DataFrame) -> DataFrame:
    """Logs with the names of their endpoint and publisher; both catalog tables are joined first."""
    named = endpoints.select(
        F.col("id").alias("source_endpoint_id"), F.col("display_name").alias("endpoint_name"), "publisher_id"
    ).join(publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name")),
           "publisher_id", "left")
    return logs.join(named, "source_endpoint_id", "left")
