"""Checks of endpoint selection, attempts, state and runs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import runs as R
from . import adapters as A
from .registry import check

_NOW = f"TIMESTAMP '{A.NOW}'"


@check("eligible", f"""
    SELECT id FROM t_endpoints WHERE enabled AND (blocked_until IS NULL OR blocked_until < {_NOW})
      AND (last_fetched_at IS NULL OR last_fetched_at < {_NOW} - to_minutes(fetch_interval_minutes))
    """, ("t_endpoints",))
def eligible(spark, d):
    return R.eligible_endpoints(A.endpoints(spark, d), A.now()).select("id")


@check("state_preds", f"""
    SELECT 'enabled rss' AS pred, id FROM t_endpoints WHERE enabled AND kind = 'RSS'
    UNION ALL SELECT 'indexed', id FROM t_articles WHERE status = 'INDEXED'
    UNION ALL SELECT 'error of 7', id FROM t_articles WHERE status = 'ERROR' AND publisher_id = 7
    UNION ALL SELECT 'unmapped', id FROM t_publishers WHERE rating_id IS NULL
    UNION ALL SELECT 'pending', id FROM t_logs WHERE completed_at IS NULL
    UNION ALL SELECT 'old runs', id FROM t_runs WHERE status = 'RUNNING' AND started_at < TIMESTAMP '2024-01-10'
    """, ("t_endpoints", "t_articles", "t_publishers", "t_logs", "t_runs"))
def state_preds(spark, d):
    articles, tag = A.articles(spark, d), lambda name, df: df.select(F.lit(name).alias("pred"), "id")
    cutoff = F.lit("2024-01-10").cast("timestamp")
    return (
        tag("enabled rss", R.enabled_of_kind(A.endpoints(spark, d), "RSS"))
        .unionByName(tag("indexed", R.articles_in(articles, "INDEXED")))
        .unionByName(tag("error of 7", R.articles_in(articles, "ERROR", 7)))
        .unionByName(tag("unmapped", R.unmapped_publishers(A.publishers(spark, d))))
        .unionByName(tag("pending", R.pending_logs(A.logs(spark, d))))
        .unionByName(tag("old runs", R.runs_before(A.runs(spark, d), "RUNNING", cutoff)))
    )


def run_items(spark, d):
    """Items of an attempt: run by user, endpoint by hour block, outcome by event type and value."""
    return A.load(spark, d, "events").selectExpr(
        "user_id as run_id",
        "event_id % 5 as endpoint_id",
        "event_id as pos",
        "event_type = 'signup' and value < 20 as skipped",
        "value >= 5 as is_new",
        "event_type not in ('error') and not (event_type = 'click' and value > 250) as success",
        "event_type <> 'purchase' or value < 150 as indexed",
        "case when event_type = 'error' then case when value > 100 then 'BLOCKED_OR_CAPTCHA' when value < 8"
        " then 'ROBOTS_DISALLOWED' when value < 60 then 'EXTRACTION_FAILED' end end as reason",
    )


_ITEMS = """
    items AS (
      SELECT user_id AS run_id, event_id % 5 AS endpoint_id, event_id AS pos,
        event_type <> 'error' AND NOT (event_type = 'click' AND value > 250) AS success,
        event_type <> 'purchase' OR value < 150 AS indexed,
        CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 'BLOCKED_OR_CAPTCHA' WHEN value < 8
          THEN 'ROBOTS_DISALLOWED' WHEN value < 60 THEN 'EXTRACTION_FAILED' END END AS reason
      FROM events WHERE NOT (event_type = 'signup' AND value < 20) AND value >= 5
    ), kept AS (
      SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN reason IN ('BLOCKED_OR_CAPTCHA', 'ROBOTS_DISALLOWED') THEN 1 ELSE 0 END)
        OVER (PARTITION BY run_id, endpoint_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops
        FROM items) WHERE stops = 0
    )"""


@check("stop_signal", f"SELECT * FROM (WITH {_ITEMS} SELECT run_id, endpoint_id, pos, reason FROM kept)")
def stop_signal(spark, d):
    return R.stop_at_signal(run_items(spark, d)).select("run_id", "endpoint_id", "pos", "reason")


def fetches(spark, d):
    return A.load(spark, d, "events").groupBy(F.col("user_id").alias("run_id"), (F.col("event_id") % 5).alias("endpoint_id")).agg(
        F.count("*").alias("fetched"), F.min("event_id").alias("first")
    ).selectExpr(
        "run_id", "endpoint_id", "fetched",
        "if(first % 13 = 4, 'HTTP 500', null) as fetch_error",
        "concat('https://example.com/', first) as sample_url",
        "first % 11 <> 3 as sample_allowed",
    )


def attempt_endpoints(spark, d):
    """Five endpoints per run id, keyed by both."""
    return A.load(spark, d, "events").selectExpr("event_id % 5 as id").distinct().selectExpr(
        "id", "id = 4 as robots_disallowed",
        f"if(id = 3, timestamp'{A.NOW}' + make_dt_interval(1), null) as blocked_until",
    )


_ATTEMPT = f"""
    {_ITEMS}, counts AS (
      SELECT run_id, endpoint_id, count(*) FILTER (success AND indexed) AS processed,
        count(*) FILTER (NOT (success AND indexed)) AS failed, bool_or(success) AS had_success,
        CASE WHEN bool_or(reason = 'ROBOTS_DISALLOWED') THEN 'ROBOTS_DISALLOWED'
          WHEN bool_or(reason = 'BLOCKED_OR_CAPTCHA') THEN 'BLOCKED_OR_CAPTCHA'
          WHEN bool_or(reason = 'EXTRACTION_FAILED') THEN 'EXTRACTION_FAILED' END AS reason
      FROM kept GROUP BY run_id, endpoint_id
    ), landed AS (
      SELECT user_id AS run_id, event_id % 5 AS endpoint_id, count(*) AS fetched, min(event_id) AS first
      FROM events GROUP BY 1, 2
    ), attempts AS (
      SELECT l.run_id, l.endpoint_id,
        CASE WHEN endpoint_id_ IN (3, 4) THEN 'SKIPPED' WHEN first % 13 = 4 THEN 'FAILED' WHEN first % 11 = 3 THEN 'SKIPPED'
          WHEN coalesce(failed, 0) = 0 THEN 'SUCCESS' WHEN processed > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status,
        CASE WHEN endpoint_id_ = 4 THEN 'Robots.txt disallows scraping for this source'
          WHEN endpoint_id_ = 3 THEN 'Source blocked until 1998-06-02T00:00:00Z' WHEN first % 13 = 4 THEN 'Fetch error: HTTP 500'
          WHEN first % 11 = 3 THEN 'Robots.txt disallows scraping for https://example.com/' || first END AS error_details,
        CASE WHEN endpoint_id_ IN (3, 4) OR first % 13 = 4 THEN 0 ELSE fetched END AS articles_fetched,
        CASE WHEN endpoint_id_ IN (3, 4) OR first % 13 = 4 OR first % 11 = 3 THEN 0 ELSE coalesce(processed, 0) END
          AS articles_processed,
        CASE WHEN endpoint_id_ IN (3, 4) OR first % 13 = 4 OR first % 11 = 3 THEN 0 ELSE coalesce(failed, 0) END AS articles_failed,
        NOT (endpoint_id_ IN (3, 4) OR first % 13 = 4 OR first % 11 = 3) AS worked,
        endpoint_id_ NOT IN (3, 4) AND first % 13 = 4 AS fetch_failed,
        endpoint_id_ NOT IN (3, 4) AND first % 13 <> 4 AND first % 11 = 3 AS sample_barred, had_success, reason
      FROM (SELECT *, endpoint_id AS endpoint_id_ FROM landed) l
      LEFT JOIN counts c ON c.run_id = l.run_id AND c.endpoint_id = l.endpoint_id
    )"""


def _attempts(spark, d):
    return R.endpoint_attempt(fetches(spark, d), attempt_endpoints(spark, d), run_items(spark, d), A.now())


@check("endpoint_attempt", f"""
    SELECT * FROM (WITH {_ATTEMPT}
    SELECT run_id, endpoint_id, status, error_details, articles_fetched, articles_processed, articles_failed FROM attempts)
    """)
def endpoint_attempt(spark, d):
    return _attempts(spark, d).select("run_id", "endpoint_id", "status", "error_details", "articles_fetched",
                                      "articles_processed", "articles_failed")


@check("endpoint_state", f"""
    SELECT * FROM (WITH {_ATTEMPT}, tried AS (
      SELECT a.*, run_id * 5 + endpoint_id AS id, sample_barred OR (worked AND reason = 'ROBOTS_DISALLOWED') AS robots,
        worked AND (reason = 'BLOCKED_OR_CAPTCHA' OR (reason = 'EXTRACTION_FAILED' AND NOT had_success)) AS blocking,
        worked AND reason IS NULL AND had_success AS clear FROM attempts a
    ), s AS (
      SELECT e.*, t.id IS NOT NULL AS tried, coalesce(t.robots, FALSE) AS robots, coalesce(t.blocking, FALSE) AS blocking,
        coalesce(t.clear, FALSE) AS clear, coalesce(t.worked, FALSE) AS worked, t.reason, t.status,
        coalesce(t.fetch_failed, FALSE) AS fetch_failed, coalesce(t.sample_barred, FALSE) AS sample_barred, t.articles_failed
      FROM t_endpoints e LEFT JOIN tried t ON t.id = e.id
    )
    SELECT id, robots_disallowed OR robots AS robots_disallowed,
      CASE WHEN robots OR clear THEN 0 WHEN blocking THEN block_count + 1 ELSE block_count END AS block_count,
      CASE WHEN robots THEN 'ROBOTS_DISALLOWED' WHEN clear THEN NULL WHEN blocking THEN reason ELSE block_reason END AS block_reason,
      strftime(CASE WHEN robots OR clear THEN NULL WHEN blocking AND block_count + 1 >= 2 THEN {_NOW} + to_hours(24)
        ELSE blocked_until END, '%Y-%m-%d %H:%M:%S') AS blocked_until,
      CASE WHEN worked AND articles_failed = 0 THEN 0 WHEN worked OR fetch_failed THEN failure_count + 1 ELSE failure_count END
        AS failure_count,
      strftime(CASE WHEN sample_barred OR (worked AND status IN ('SUCCESS', 'PARTIAL')) THEN {_NOW} ELSE last_fetched_at END,
        '%Y-%m-%d %H:%M:%S') AS last_fetched_at,
      CASE WHEN worked AND articles_failed = 0 THEN '{A.NOW}' END AS last_success_at,
      CASE WHEN tried THEN '{A.NOW}' END AS last_attempted_at
    FROM s)
    """, ("t_endpoints",))
def endpoint_state(spark, d):
    attempts = _attempts(spark, d).withColumn("endpoint_id", F.col("run_id") * 5 + F.col("endpoint_id"))
    out = R.update_endpoint_state(A.endpoints(spark, d), attempts, A.now())
    return out.select("id", "robots_disallowed", "block_count", "block_reason", A.stamp("blocked_until"), "failure_count",
                      A.stamp("last_fetched_at"), A.stamp("last_success_at"), A.stamp("last_attempted_at"))


_ROLLUP = """
    SELECT run_id, success_count, partial_count, failure_count,
      CASE WHEN success_count = 0 AND partial_count = 0 THEN 'FAILED' WHEN failure_count = 0 AND partial_count = 0 THEN 'COMPLETED'
        ELSE 'PARTIAL' END AS status
    FROM (SELECT run_id, count(*) FILTER (completed_at IS NULL) AS pending, count(*) FILTER (status = 'SUCCESS') AS success_count,
        count(*) FILTER (status = 'PARTIAL') AS partial_count,
        count(*) FILTER (status = 'FAILED' AND NOT coalesce(regexp_matches(lower(error_details),
          'robots[.]txt disallows|source blocked until|too many chunks for embedding|too many texts in one request|unprocessable entity|nlp embed failed'),
          FALSE)) AS failure_count
      FROM t_logs GROUP BY run_id) WHERE pending = 0"""


@check("run_rollup", _ROLLUP, ("t_logs",))
def run_rollup(spark, d):
    return R.run_rollup(A.logs(spark, d))


@check("runs_complete", """
    SELECT id, EXISTS (SELECT 1 FROM t_logs l WHERE l.run_id = r.id AND l.status IN ('FAILED', 'PARTIAL')) AS with_failures
    FROM t_runs r WHERE status = 'RUNNING'
      AND NOT EXISTS (SELECT 1 FROM t_logs l WHERE l.run_id = r.id AND l.completed_at IS NULL)
    """, ("t_runs", "t_logs"))
def runs_complete(spark, d):
    runs, logs = A.runs(spark, d), A.logs(spark, d)
    tag = lambda flag: R.runs_complete(runs, logs, flag).select("id", F.lit(flag).alias("with_failures"))
    return tag(True).unionByName(tag(False))


_EXPIRE_NOW = "2024-01-20 00:00:00"


def _expired(spark, d):
    now = F.lit(_EXPIRE_NOW).cast("timestamp")
    return R.expire_runs(A.runs(spark, d), A.logs(spark, d), now, timedelta(hours=12))


@check("expire_runs", f"""
    SELECT id, CASE WHEN stale THEN 'FAILED' ELSE status END AS status, CASE WHEN stale THEN 1 ELSE 0 END AS version,
      CASE WHEN stale THEN '{_EXPIRE_NOW}' ELSE strftime(completed_at, '%Y-%m-%d %H:%M:%S') END AS completed_at
    FROM (SELECT *, status = 'RUNNING' AND started_at < TIMESTAMP '{_EXPIRE_NOW}' - to_hours(12) AS stale FROM t_runs)
    """, ("t_runs",))
def expire_runs(spark, d):
    return _expired(spark, d)[0].select("id", "status", "version", A.stamp("completed_at"))


@check("expire_logs", f"""
    SELECT id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status, CASE WHEN hit THEN 1 ELSE 0 END AS version,
      CASE WHEN hit THEN 'Run exceeded timeout and was marked stale/FAILED' ELSE error_details END AS error_details
    FROM (SELECT l.*, completed_at IS NULL AND run_id IN (SELECT id FROM t_runs WHERE status = 'RUNNING'
        AND started_at < TIMESTAMP '{_EXPIRE_NOW}' - to_hours(12)) AS hit FROM t_logs l)
    """, ("t_runs", "t_logs"))
def expire_logs(spark, d):
    return _expired(spark, d)[1].select("id", "status", "version", "error_details")


@check("undispatched_logs", """
    SELECT id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status,
      CASE WHEN hit THEN 'Enqueue failed before dispatch: queue down' ELSE error_details END AS error_details
    FROM (SELECT l.*, completed_at IS NULL AND NOT EXISTS (SELECT 1 FROM t_logs o WHERE o.run_id = l.run_id
        AND o.source_endpoint_id = l.source_endpoint_id AND o.status = 'SUCCESS') AS hit FROM t_logs l)
    """, ("t_logs",))
def undispatched_logs(spark, d):
    logs = A.logs(spark, d)
    keys = ["run_id", "source_endpoint_id"]
    planned = logs.select(*keys).distinct()
    dispatched = logs.filter("status = 'SUCCESS'").select(*keys).distinct()
    out = R.fail_undispatched(logs, planned, dispatched, "queue down", A.now())
    return out.select("id", "status", "error_details")


@check("log_view", """
    SELECT l.id, l.run_id, l.status, e.display_name AS endpoint_name, p.name AS publisher_name FROM t_logs l
    LEFT JOIN t_endpoints e ON e.id = l.source_endpoint_id LEFT JOIN t_publishers p ON p.id = e.publisher_id
    """, ("t_logs", "t_endpoints", "t_publishers"))
def log_view(spark, d):
    view = R.log_view(A.logs(spark, d), A.endpoints(spark, d), A.publishers(spark, d))
    return view.select("id", "run_id", "status", "endpoint_name", "publisher_name")


@check("active_run", """
    SELECT id, status FROM t_runs WHERE status = 'RUNNING' ORDER BY started_at DESC, id DESC LIMIT 1
    """, ("t_runs",))
def active_run(spark, d):
    return R.active_run(A.runs(spark, d)).select("id", "status")
