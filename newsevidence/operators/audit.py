"""Integrity rules of the tables, as queries that return their violations.

Every rule gives rows ``(table, rule, key, detail)``; an empty result means the table is sound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Parts that keys are dealt over. Stated, because sorted ids compress so well that a number chosen by bytes puts millions
#: of rows into one task, or sends them to all.
PARTS = 64
#: Parents that may be sent to every task.
BROADCAST_ROWS = 500_000


def _rows(df: DataFrame, table: str, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def unique(df: DataFrame, table: str, rule: str, keys: list[Column]) -> DataFrame:
    """Values that several rows share. Rows are grouped by the columns themselves; the reported key joins them by ``|``.

    Nearly all keys are distinct, so nothing is gained by counting before the shuffle.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    counted = df.select(*named).repartition(PARTS, *names).groupBy(*names).agg(F.count("*").alias("_n"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    return _rows(counted.filter("_n > 1"), table, rule, key, F.col("_n"))


def foreign_key(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str, id_col: str) -> DataFrame:
    """Rows whose reference has no parent. Parents are counted: few are sent to all tasks, many are sorted in PARTS parts."""
    refs = df.filter(F.col(column).isNotNull()).select(F.col(id_col).alias("_id"), F.col(column).alias("_ref"))
    known = parent.select(F.col(parent_key).alias("_ref"))
    if known.count() <= BROADCAST_ROWS:
        orphans = refs.join(F.broadcast(known), "_ref", "left_anti")
    else:
        orphans = refs.repartition(PARTS, "_ref").join(known.repartition(PARTS, "_ref").hint("merge"), "_ref", "left_anti")
    return _rows(orphans, table, f"fk_{column}", F.col("_id"), F.col("_ref"))


def check(df: DataFrame, table: str, rule: str, id_col: str, good: Column, detail: Column | None = None) -> DataFrame:
    bad = df.filter(~F.coalesce(good, F.lit(False)))
    return _rows(bad, table, rule, F.col(id_col), F.lit("") if detail is None else detail)


def required(df: DataFrame, table: str, column: str, id_col: str) -> DataFrame:
    return check(df, table, f"required_{column}", id_col, ~is_blank(F.col(column).cast("string")))


def allowed(df: DataFrame, table: str, column: str, values: list[str], id_col: str) -> DataFrame:
    return check(df, table, f"allowed_{column}", id_col, F.col(column).isin(values), F.col(column))


def max_length(df: DataFrame, table: str, column: str, limit: int, id_col: str) -> DataFrame:
    ok = F.col(column).isNull() | (F.length(column) <= limit)
    return check(df, table, f"length_{column}", id_col, ok, F.length(column))


def kind_fields(endpoints: DataFrame) -> DataFrame:
    """RSS endpoints have only a feed URL, API endpoints only provider and query."""
    rss = (F.col("kind") == "RSS") & F.col("rss_url").isNotNull() & F.col("api_provider").isNull() & F.col(
        "api_query").isNull()
    api = (F.col("kind") == "API") & F.col("rss_url").isNull() & F.col("api_provider").isNotNull() & F.col(
        "api_query").isNotNull()
    return check(endpoints, "source_endpoints", "kind_fields", "id", rss | api, F.col("kind"))


def single_running(runs: DataFrame) -> DataFrame:
    running = runs.filter("status = 'RUNNING'").agg(F.count("*").alias("_n"))
    return _rows(running.filter("_n > 1"), "ingestion_runs", "single_running", F.lit("RUNNING"), F.col("_n"))


def audit(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def row_rules(df: DataFrame, table: str, id_col: str, rules: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """Rows that break any of ``rules`` (name, what must hold, detail), found in one scan of the table."""
    found = F.array_compact(F.array(*[
        F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(name).alias("rule"), _text(detail).alias("detail")))
        for name, good, detail in rules
    ]))
    bad = df.select(F.col(id_col).cast("string").alias("key"), F.explode(found).alias("_v"))
    return bad.select(F.lit(table).alias("table_name"), F.col("_v.rule").alias("rule"), "key", F.col("_v.detail").alias("detail"))


def _text(detail: Column | None) -> Column:
    return F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit("null"))


def _filled(column: str) -> tuple[str, Column, None]:
    return f"required_{column}", ~is_blank(F.col(column).cast("string")), None


def _one_of(column: str, values: list[str]) -> tuple[str, Column, Column]:
    return f"allowed_{column}", F.col(column).isin(values), F.col(column)


def _at_most(column: str, limit: int) -> tuple[str, Column, Column]:
    return f"length_{column}", F.col(column).isNull() | (F.length(column) <= limit), F.length(column)


def audit_catalog(publishers: DataFrame, endpoints: DataFrame, articles: DataFrame, ratings: DataFrame,
                  links: DataFrame, runs: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """The rules of the catalog and article tables, and of runs and logs where given.

    Each table is scanned once for its row rules and once per key rule.
    """
    from ..schemas import ALLOWED

    locator = ["publisher_id", "kind", "rss_url", "api_provider", "api_query"]
    rss = (F.col("kind") == "RSS") & F.col("rss_url").isNotNull() & F.col("api_provider").isNull() & F.col(
        "api_query").isNull()
    api = (F.col("kind") == "API") & F.col("rss_url").isNull() & F.col("api_provider").isNotNull() & F.col(
        "api_query").isNotNull()
    rules = [
        row_rules(publishers, "publishers", "id", [_filled("name"), _at_most("name", 255), _at_most("country_code", 2)]),
        unique(publishers, "publishers", "unique_name", [F.lower("name")]),
        foreign_key(publishers, "publishers", "rating_id", ratings, "rating_id", "id"),
        row_rules(endpoints, "source_endpoints", "id", [
            ("kind_fields", rss | api, F.col("kind")), _one_of("kind", ALLOWED["source_endpoints", "kind"])]),
        unique(endpoints, "source_endpoints", "unique_locator", [F.col(c) for c in locator]),
        foreign_key(endpoints, "source_endpoints", "publisher_id", publishers, "id", "id"),
        row_rules(articles, "articles", "id", [
            _filled("canonical_url"), _filled("canonical_url_hash"), _one_of("status", ALLOWED["articles", "status"])]),
        unique(articles, "articles", "unique_url", [F.col("publisher_id"), F.col("canonical_url_hash")]),
        foreign_key(articles, "articles", "publisher_id", publishers, "id", "id"),
        unique(links, "article_sources", "unique_item", [F.col("source_endpoint_id"), F.col("source_item_id")]),
        foreign_key(links, "article_sources", "article_id", articles, "id", "article_id"),
        foreign_key(links, "article_sources", "source_endpoint_id", endpoints, "id", "article_id"),
    ]
    if runs is not None:
        rules += [
            row_rules(runs, "ingestion_runs", "id", [
                _filled("started_at"), _one_of("status", ALLOWED["ingestion_runs", "status"])]),
            single_running(runs),
        ]
    if logs is not None:
        rules += [
            row_rules(logs, "ingestion_logs", "id", [
                _filled("source_endpoint_id"), _filled("started_at"), _one_of("status", ALLOWED["ingestion_logs", "status"])]),
            unique(logs.filter("run_id is not null"), "ingestion_logs", "unique_run_endpoint", [F.col("run_id"), F.col("source_endpoint_id")]),
        ]
        if runs is not None:
            rules.append(foreign_key(logs, "ingestion_logs", "run_id", runs, "id", "id"))
    return audit(*rules)
