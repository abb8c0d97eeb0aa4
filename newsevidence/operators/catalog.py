"""Publishers, endpoints and ratings: sync, mapping, patches, lookups, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normalize_domain, rated_domain
from ..functions.text import is_blank, lower_or, trim_to_null, upper_or
from ..sources.feeds import PROVIDER
from .keyed import keep_first, upsert

# Fixed values.
API_INTERVAL_MINUTES = 30
RATING_TEXTS = ["source_name", "rating_url", "bias", "country", "factual_reporting", "media_type", "credibility"]


def clean_ratings(entries: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """First entry per rating id, blanks as nulls, site kept only with a valid dotted domain."""
    first = keep_first(entries.filter(F.col("rating_id").isNotNull()), ["rating_id"], [F.asc(c) for c in order])
    domain = rated_domain("source_url")
    tidy = first.withColumn("source_url_domain", domain)
    return tidy.select(
        "rating_id",
        *[trim_to_null(c).alias(c) for c in RATING_TEXTS],
        F.when(F.col("source_url_domain").isNotNull(), trim_to_null("source_url")).alias("source_url"),
        "source_url_domain",
    )


def sync_ratings(entries: DataFrame, ratings: DataFrame, now: Column, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Ratings after a sync: cleaned entries replace stored rows of the same id."""
    fresh = clean_ratings(entries, order).withColumn("synced_at", now)
    return upsert(ratings, fresh, ["rating_id"], "replace", now=now)


def map_publishers(publishers: DataFrame, ratings: DataFrame) -> DataFrame:
    """``(id, rating_id)`` of unmapped publishers whose site domain is rated; smallest id per domain wins."""
    by_domain = ratings.filter(F.col("source_url_domain").isNotNull()).groupBy("source_url_domain").agg(
        F.min("rating_id").alias("rating_id")
    )
    sites = publishers.filter(F.col("rating_id").isNull()).select(
        "id", normalize_domain("website_url").alias("source_url_domain")
    )
    return sites.join(by_domain, "source_url_domain").select("id", "rating_id")


def apply_mapping(publishers: DataFrame, mapping: DataFrame, now: Column) -> DataFrame:
    return upsert(publishers, mapping, ["id"], "fill", now=now)


def rating_sync_counts(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: fetched, saved, mapped."""
    fetched = entries.agg(F.count("*").alias("fetched"), F.count_distinct("rating_id").alias("saved"))
    mapped = mapping.agg(F.count("*").alias("mapped"))
    one = F.lit(1).alias("_one")
    return fetched.select("*", one).join(mapped.select("*", one), "_one").drop("_one")


def _clean_sources(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "pos",
        lower_or("source_id").alias("source_id"),
        trim_to_null("name").alias("name"),
        upper_or("country").alias("country_code"),
        trim_to_null("url").alias("website_url"),
    ).withColumn("name_key", F.lower("name"))


def _grouped_sources(catalog: DataFrame) -> DataFrame:
    """Per publisher name: what the sources say in file order, and where each value first appears."""
    rows = _clean_sources(catalog).filter(F.col("source_id").isNotNull() & F.col("name").isNotNull())
    given = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    return rows.groupBy("name_key").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("name", "pos").alias("name"),
        F.min(given("country_code")).alias("country_pos"),
        F.min_by("country_code", given("country_code")).alias("country_code"),
        F.min(given("website_url")).alias("site_pos"),
        F.min_by("website_url", given("website_url")).alias("website_url"),
    )


def sync_source_publishers(catalog: DataFrame, publishers: DataFrame, now: Column) -> DataFrame:
    """Publishers after a source sync: absent names added, blank country and site filled.

    New publishers carry no id here; the natural key is the lower-cased name.
    """
    keyed = publishers.withColumn("name_key", F.lower("name"))
    fresh = _grouped_sources(catalog).select("name_key", "name", "country_code", "website_url")
    return upsert(keyed, fresh, ["name_key"], "fill", now=now, action="action")


def sync_source_endpoints(catalog: DataFrame, publishers: DataFrame, endpoints: DataFrame,
                          provider: str = PROVIDER) -> DataFrame:
    """API endpoints a source sync adds: one per (publisher name, source id) that has none yet."""
    rows = _clean_sources(catalog).filter(F.col("source_id").isNotNull() & F.col("name").isNotNull())
    wanted = rows.groupBy("name_key", F.col("source_id").alias("api_query")).agg(
        F.min_by("name", "pos").alias("display_name")
    )
    names = publishers.select(F.col("id").alias("publisher_id"), F.lower("name").alias("name_key"))
    have = endpoints.filter((F.col("kind") == "API") & (F.col("api_provider") == provider)).join(
        names, "publisher_id"
    ).select("name_key", "api_query")
    return wanted.join(have, ["name_key", "api_query"], "left_anti").select(
        "name_key",
        F.lit("API").alias("kind"),
        "display_name",
        F.lit(provider).alias("api_provider"),
        "api_query",
        F.lit(True).alias("enabled"),
        F.lit(API_INTERVAL_MINUTES).alias("fetch_interval_minutes"),
    )


def source_sync_counts(catalog: DataFrame, publishers: DataFrame, endpoints: DataFrame,
                       provider: str = PROVIDER) -> DataFrame:
    """One row: fetched, created endpoints, enriched publishers, existing.

    A source enriches a publisher that was there before it; the source that makes a new publisher
    does not count.
    """
    have = publishers.select(
        F.lower("name").alias("name_key"),
        is_blank("country_code").alias("no_country"),
        is_blank("website_url").alias("no_site"),
    )
    groups = _grouped_sources(catalog).join(have, "name_key", "left")
    new = F.col("no_country").isNull()
    first = F.when(new, F.col("first_pos")).otherwise(F.lit(-1))
    fills = F.array_distinct(F.array_compact(F.array(
        F.when((F.coalesce("no_country", F.lit(True))) & (F.col("country_pos") != first), F.col("country_pos")),
        F.when((F.coalesce("no_site", F.lit(True))) & (F.col("site_pos") != first), F.col("site_pos")),
    )))
    one = F.lit(1).alias("_one")
    enriched = groups.agg(F.coalesce(F.sum(F.size(fills)), F.lit(0)).alias("enriched_publishers")).select("*", one)
    created = sync_source_endpoints(catalog, publishers, endpoints, provider).agg(
        F.count("*").alias("created_endpoints")
    ).select("*", one)
    fetched = catalog.agg(F.count("*").alias("fetched")).select("*", one)
    joined = fetched.join(created, "_one").join(enriched, "_one").drop("_one")
    return joined.withColumn("existing", F.col("fetched") - F.col("created_endpoints"))


def publisher_by_name(publishers: DataFrame, names: DataFrame) -> DataFrame:
    """Publishers looked up by name, ignoring case: ``names(name)`` to ``(wanted, id, name)``."""
    wanted = names.select(F.col("name").alias("wanted"), F.lower("name").alias("_k"))
    return wanted.join(publishers.withColumn("_k", F.lower("name")), "_k").select("wanted", "id", "name")


def endpoint_by_locator(endpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Endpoints by (publisher, kind, provider, query), text ignoring case."""
    keys = ["publisher_id", "kind", "_p", "_q"]
    lowered = lambda df: df.withColumn("_p", F.lower("api_provider")).withColumn("_q", F.lower("api_query"))
    return lowered(wanted).select(*keys).join(lowered(endpoints), keys).drop("_p", "_q")


def deletable_publishers(publishers: DataFrame, endpoints: DataFrame, articles: DataFrame) -> DataFrame:
    """``(id, blocked_by)``: null where nothing refers to the publisher. Endpoints are named first."""
    has_ep = endpoints.select(F.col("publisher_id").alias("id")).distinct().withColumn("_ep", F.lit(True))
    has_art = articles.select(F.col("publisher_id").alias("id")).distinct().withColumn("_art", F.lit(True))
    joined = publishers.select("id").join(has_ep, "id", "left").join(has_art, "id", "left")
    why = F.when(F.col("_ep"), F.lit("source endpoints")).when(F.col("_art"), F.lit("articles"))
    return joined.select("id", why.alias("blocked_by"))


def deletable_ratings(ratings: DataFrame, publishers: DataFrame) -> DataFrame:
    used = publishers.filter(F.col("rating_id").isNotNull()).select("rating_id").distinct()
    used = used.withColumn("_used", F.lit(True))
    return ratings.select("rating_id").join(used, "rating_id", "left").select(
        F.col("rating_id").alias("id"), F.when(F.col("_used"), F.lit("publishers")).alias("blocked_by")
    )


def publisher_list(publishers: DataFrame) -> DataFrame:
    return publishers.select("id", "name", "country_code", "website_url", "rating_id").orderBy("id")


def endpoint_list(endpoints: DataFrame, publishers: DataFrame) -> DataFrame:
    names = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"))
    return endpoints.join(names, "publisher_id", "left").orderBy("id")


def rating_list(ratings: DataFrame) -> DataFrame:
    return ratings.orderBy("rating_id")


def _patched(patch: str, old: str, nullable: bool = True) -> Column:
    new = F.col(f"_n_{patch}")
    value = trim_to_null(new) if nullable else F.coalesce(trim_to_null(new), F.col(old))
    return F.when(new.isNotNull(), value).otherwise(F.col(old))


def _prepare(current: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Every patch next to the row it names, patch values under ``_n_``."""
    renamed = patches.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in patches.columns if c != key])
    return renamed.join(current.withColumn("_found", F.lit(True)), key, "left")


def _holders(current: DataFrame, value: Column, out: str) -> DataFrame:
    """Per value the smallest and largest id that hold it: one row, however often it occurs."""
    return current.groupBy(value.alias(out)).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))


def _held_by_other() -> Column:
    return F.coalesce((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), F.lit(False))


def _split(prepared: DataFrame, key: str, reason: Column, new: dict[str, Column], current: DataFrame,
           now: Column, stamp: str) -> tuple[DataFrame, DataFrame]:
    judged = prepared.withColumn("reject_reason", reason)
    rejects = judged.filter(F.col("reject_reason").isNotNull()).select(key, "reject_reason")
    ok = judged.filter(F.col("reject_reason").isNull())
    cols = [c for c in current.columns]
    new = {**new, stamp: now} if stamp in cols else new
    changed = ok.select(*[new[c].alias(c) if c in new else F.col(c) for c in cols])
    kept = current.join(ok.select(key), key, "left_anti")
    return kept.unionByName(changed), rejects


def patch_publishers(publishers: DataFrame, patches: DataFrame, ratings: DataFrame,
                     now: Column) -> tuple[DataFrame, DataFrame]:
    """Publishers after ``patches`` (one per id), and ``(id, reject_reason)``.

    Null keeps a value and blank clears it. A blank name, an unknown id or rating, and a name that
    another publisher or an earlier patch holds are rejected.
    """
    p = _prepare(publishers, patches, "id")
    holders = _holders(publishers, F.lower("name"), "_k")
    known = ratings.select(F.col("rating_id").alias("_n_rating_id"), F.lit(True).alias("_rated"))
    p = p.withColumn("_k", F.lower(trim_to_null("_n_name"))).join(holders, "_k", "left")
    p = p.join(known, "_n_rating_id", "left")
    # Only patches that pass the other rules claim a name.
    missing, blank = F.col("_found").isNull(), F.col("_n_name").isNotNull() & is_blank("_n_name")
    unrated = F.col("_n_rating_id").isNotNull() & F.col("_rated").isNull()
    claims = p.filter(~missing & ~blank & ~unrated & ~_held_by_other() & F.col("_k").isNotNull()).groupBy("_k").agg(
        F.min("id").alias("_claimer")
    )
    p = p.join(claims, "_k", "left")
    taken = _held_by_other() | F.coalesce(F.col("_claimer") < F.col("id"), F.lit(False))
    reason = (
        F.when(missing, F.lit("not found"))
        .when(blank, F.lit("name must not be blank"))
        .when(taken, F.lit("name already exists"))
        .when(unrated, F.lit("rating not found"))
    )
    new = {
        "name": _patched("name", "name", nullable=False),
        "country_code": _patched("country_code", "country_code"),
        "website_url": _patched("website_url", "website_url"),
        "rating_id": F.coalesce("_n_rating_id", "rating_id"),
    }
    return _split(p, "id", reason, new, publishers, now, "updated_at")


LOCATOR = ["publisher_id", "kind", "rss_url", "api_provider", "api_query"]


def patch_endpoints(endpoints: DataFrame, patches: DataFrame, publishers: DataFrame,
                    now: Column) -> tuple[DataFrame, DataFrame]:
    """Endpoints after ``patches``; fields of the other kind are cleared, missing locators rejected.

    A locator that another endpoint holds, or that an earlier patch takes, is rejected.
    """
    p = _prepare(endpoints, patches, "id")
    given = [c[3:] for c in p.columns if c.startswith("_n_")]
    value = lambda c: F.coalesce(f"_n_{c}", c) if c in given else F.col(c)
    for c in ("publisher_id", "kind", "display_name", "rss_url", "api_provider", "api_query", "enabled",
              "fetch_interval_minutes"):
        p = p.withColumn(f"_v_{c}", value(c))
    rss, api = F.col("_v_kind") == "RSS", F.col("_v_kind") == "API"
    p = (
        p.withColumn("_v_api_provider", F.when(~rss, F.col("_v_api_provider")))
        .withColumn("_v_api_query", F.when(~rss, F.col("_v_api_query")))
        .withColumn("_v_rss_url", F.when(~api, F.col("_v_rss_url")))
    )
    locator = lambda prefix: F.concat_ws("\u001f", *[
        F.coalesce(F.col(prefix + c).cast("string"), F.lit("")) for c in LOCATOR
    ])
    p = p.withColumn("_loc", locator("_v_"))
    held = _holders(endpoints, locator(""), "_loc")
    owner = publishers.select(F.col("id").alias("_v_publisher_id"), F.lit(True).alias("_owned"))
    p = p.join(held, "_loc", "left").join(owner, "_v_publisher_id", "left")
    wrong = (
        F.when(F.col("_found").isNull(), F.lit("not found"))
        .when(F.col("_owned").isNull(), F.lit("publisher not found"))
        .when(F.col("_v_kind").isNull(), F.lit("kind is required"))
        .when(rss & is_blank("_v_rss_url"), F.lit("rss_url is required"))
        .when(api & is_blank("_v_api_provider"), F.lit("api_provider is required"))
        .when(api & is_blank("_v_api_query"), F.lit("api_query is required"))
    )
    # Only patches that pass the other rules claim a locator.
    claims = p.filter(wrong.isNull() & ~_held_by_other()).groupBy("_loc").agg(F.min("id").alias("_claimer"))
    p = p.join(claims, "_loc", "left")
    clash = _held_by_other() | F.coalesce(F.col("_claimer") < F.col("id"), F.lit(False))
    reason = F.coalesce(wrong, F.when(clash, F.lit("endpoint already exists")))
    new = {c[3:]: F.col(c) for c in p.columns if c.startswith("_v_")}
    return _split(p, "id", reason, new, endpoints, now, "updated_at")


def patch_ratings(ratings: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Ratings after ``patches``; the domain follows an explicit value, else a new site URL."""
    p = _prepare(ratings, patches, "rating_id")
    blank = lambda c: F.col(f"_n_{c}").isNotNull() & is_blank(f"_n_{c}")
    reason = (
        F.when(F.col("_found").isNull(), F.lit("not found"))
        .when(blank("source_name"), F.lit("source_name must not be blank"))
        .when(blank("rating_url"), F.lit("rating_url must not be blank"))
    )
    required = ("source_name", "rating_url")
    new = {c: _patched(c, c, nullable=c not in required) for c in [*RATING_TEXTS, "source_url"]}
    domain = F.coalesce(F.col("_n_source_url_domain"), F.col("_n_source_url"))
    p = p.withColumn("_domain", normalize_domain(domain))
    new["source_url_domain"] = F.when(domain.isNotNull(), F.col("_domain")).otherwise(F.col("source_url_domain"))
    return _split(p, "rating_id", reason, new, ratings, now, "synced_at")
