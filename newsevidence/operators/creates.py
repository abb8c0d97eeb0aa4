"""New publishers and endpoints from batches of requests, with one winner per name and per locator.

A batch stands for requests made one after the other, in order of ``pos``: an earlier good request takes a name or a
locator, a later one for the same is rejected. Rejected requests take nothing and leave nothing behind.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import sha256_hex
from ..functions.text import is_blank, trim_to_null
from .catalog import LOCATOR
from .discover import assign_ids
from .keyed import keep_first

# Fixed value: minutes between fetches of an endpoint that names none.
FETCH_INTERVAL = 30
NAME_TAKEN = "publisher already exists"


class Created(NamedTuple):
    publishers: DataFrame
    endpoints: DataFrame | None
    results: DataFrame
    """``pos, id, reject_reason``: one row per request, with the id of what it made or why it made nothing."""


def _name_key(name: str) -> Column:
    return F.lower(trim_to_null(name))


def _as_rows(made: DataFrame, like: DataFrame, values: dict[str, Column], now: Column) -> DataFrame:
    values = {**values, "created_at": now, "updated_at": now}
    return made.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in like.dtypes])


def create_publishers(publishers: DataFrame, requests: DataFrame, ratings: DataFrame, now: Column) -> Created:
    """Publishers after ``requests(pos, name, country_code, website_url, rating_id)``.

    A name must not be blank, nor held (in any case) by a publisher or an earlier good request; a rating that is named must
    exist. Blank optional values are null. New ids follow the largest, in hash order of the names.
    """
    known = publishers.select(_name_key("name").alias("_k")).distinct().withColumn("_held", F.lit(True))
    rated = ratings.select("rating_id").distinct().withColumn("_rated", F.lit(True))
    r = requests.withColumn("_k", _name_key("name")).join(known, "_k", "left").join(rated, "rating_id", "left")
    reason = (
        F.when(F.col("_k").isNull(), F.lit("name must not be blank"))
        .when(F.col("_held").isNotNull(), F.lit(NAME_TAKEN))
        .when(F.col("rating_id").isNotNull() & F.col("_rated").isNull(), F.lit("rating not found"))
    )
    judged = r.withColumn("reject_reason", reason)
    # A hot name has one row per task before it is shuffled.
    first = judged.filter("reject_reason is null").groupBy("_k").agg(F.min("pos").alias("_first"))
    judged = judged.join(first, "_k", "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("pos") > F.col("_first"), F.lit(NAME_TAKEN))))
    good = judged.filter("reject_reason is null").withColumn("_hash", sha256_hex("_k"))
    made = assign_ids(good, publishers, "_hash", "pos")
    rows = _as_rows(made, publishers, {
        "id": F.col("id"), "name": trim_to_null("name"), "country_code": trim_to_null("country_code"),
        "website_url": trim_to_null("website_url"), "rating_id": F.col("rating_id")}, now)
    results = judged.select("pos", "reject_reason").join(made.select("pos", "id"), "pos", "left").select("pos", "id", "reject_reason")
    return Created(publishers.unionByName(rows), None, results)


def create_endpoints(endpoints: DataFrame, publishers: DataFrame, requests: DataFrame, now: Column) -> Created:
    """Endpoints and publishers after ``requests(pos, publisher_id, publisher_name, country_code, website_url, kind,
    display_name, rss_url, api_provider, api_query, enabled, fetch_interval_minutes)``.

    The publisher is found by id, else by name in any case, else made together with its first good endpoint. Country and
    site of good requests are set on it, the last one given counts; its name stays. Fields of the other kind are cleared,
    then a kind and its locator are required, and a locator must not be held by an endpoint or an earlier good request.
    Endpoints are enabled and fetched every FETCH_INTERVAL minutes unless a request says otherwise. New ids follow the
    largest, in hash order of name or locator.
    """
    by_id = publishers.select(F.col("id").alias("publisher_id"), F.col("id").alias("_by_id"))
    by_name = publishers.groupBy(_name_key("name").alias("_k")).agg(F.min("id").alias("_by_name"))
    r = requests.withColumn("_k", _name_key("publisher_name")).join(by_id, "publisher_id", "left").join(by_name, "_k", "left")
    rss, api = F.col("kind") == "RSS", F.col("kind") == "API"
    for c, mine in (("rss_url", api), ("api_provider", rss), ("api_query", rss)):
        r = r.withColumn(c, F.when(~F.coalesce(mine, F.lit(False)), F.col(c)))
    owner = F.when(F.col("publisher_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_name"))
    r = r.withColumn("_owner", owner).withColumn("_who", F.coalesce(owner.cast("string"), F.concat(F.lit("name:"), "_k")))
    wrong = (
        F.when(F.col("publisher_id").isNotNull() & F.col("_by_id").isNull(), F.lit("publisher not found"))
        .when(F.col("publisher_id").isNull() & F.col("_k").isNull(), F.lit("publisher_name is required"))
        .when(F.col("kind").isNull(), F.lit("kind is required"))
        .when(rss & is_blank("rss_url"), F.lit("rss_url is required"))
        .when(api & is_blank("api_provider"), F.lit("api_provider is required"))
        .when(api & is_blank("api_query"), F.lit("api_query is required"))
    )
    locator = lambda who: F.concat_ws("\u001f", who, *[F.coalesce(F.col(c), F.lit("")) for c in LOCATOR[1:]])
    held = endpoints.select(locator(F.col("publisher_id").cast("string")).alias("_loc")).distinct().withColumn("_held", F.lit(True))
    r = r.withColumn("_loc", locator(F.col("_who"))).join(held, "_loc", "left").withColumn(
        "reject_reason", F.coalesce(wrong, F.when(F.col("_held").isNotNull(), F.lit("endpoint already exists"))))
    first = r.filter("reject_reason is null").groupBy("_loc").agg(F.min("pos").alias("_first"))
    judged = r.join(first, "_loc", "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(F.col("pos") > F.col("_first"), F.lit("endpoint already exists"))))
    good = judged.filter("reject_reason is null")

    fresh = keep_first(good.filter("_owner is null"), ["_k"], [F.asc("pos")]).withColumn("_hash", sha256_hex("_k"))
    fresh = assign_ids(fresh.drop("id"), publishers, "_hash", "pos").select("_k", F.col("id").alias("_made"), trim_to_null("publisher_name").alias("_name"))
    owned = good.join(fresh.select("_k", "_made"), "_k", "left").withColumn("_publisher", F.coalesce("_owner", "_made"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}")
    said = owned.groupBy(F.col("_publisher").alias("id")).agg(last("country_code"), last("website_url"))
    stored = _as_rows(fresh, publishers, {"id": F.col("_made"), "name": F.col("_name")}, now)
    told = publishers.unionByName(stored).join(said, "id", "left")
    news = F.col("_country_code").isNotNull() | F.col("_website_url").isNotNull()
    new = {"country_code": F.coalesce("_country_code", "country_code"), "website_url": F.coalesce("_website_url", "website_url"),
           "updated_at": F.when(news, now).otherwise(F.col("updated_at"))}
    all_publishers = told.select(*[new[c].alias(c) if c in new else F.col(c) for c in publishers.columns])

    made = assign_ids(owned.withColumn("_hash", sha256_hex("_loc")), endpoints, "_hash", "pos")
    rows = _as_rows(made, endpoints, {
        "id": F.col("id"), "publisher_id": F.col("_publisher"), "enabled": F.coalesce("enabled", F.lit(True)),
        "fetch_interval_minutes": F.coalesce("fetch_interval_minutes", F.lit(FETCH_INTERVAL)), "failure_count": F.lit(0),
        "robots_disallowed": F.lit(False), "block_count": F.lit(0),
        **{c: F.col(c) for c in ("kind", "display_name", "rss_url", "api_provider", "api_query")}}, now)
    results = judged.select("pos", "reject_reason").join(made.select("pos", "id"), "pos", "left").select("pos", "id", "reject_reason")
    return Created(all_publishers, endpoints.unionByName(rows), results)
