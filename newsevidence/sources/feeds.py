"""Landed feeds, API pages and the ratings file, read into item rows."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, lower_or, parse_iso_utc
from ..operators.keyed import keep_first, volume_rank

# API paging limits and the provider name endpoints carry.
PROVIDER = "newsapi"
PAGE_SIZE = 100
MAX_PAGES = 5
MAX_SOURCES = 20
MAX_REQUESTS = 100

# Core elements bear no prefix; date and encoded text come from the extensions that RSS and RDF feeds use for them.
_ITEM = (
    "struct<title: string, link: string, description: string, pubDate: string, guid: string, `dc:date`: string, `content:encoded`: string>"
)
_ENTRY = (
    "struct<title: string, link: array<struct<_href: string, _rel: string>>, id: string, summary: string, content: string, "
    "published: string, updated: string>"
)
# RSS keeps its items in a channel, RDF beside it, Atom calls them entries.
FEED_SCHEMA = f"channel struct<item: array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>, _broken string"
_FEED_OPTIONS = {"ignoreNamespace": "false", "columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
# What XML itself defines; all other names are HTML's.
_XML_NAMES = ("amp", "lt", "gt", "quot", "apos")
_FEED_ROOT = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:\w+:)?(rss|feed|RDF)[\s>/]"
_FEED_PREFIX = r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(\w+):(?:rss|feed|RDF)[\s>/]"
# A page holds fewer articles than this, so (page, place) is one order per batch.
PAGE_STEP = 10_000
API_SCHEMA = (
    "status string, totalResults int, code string, message string, articles array<struct<"
    "source: struct<id: string, name: string>, author: string, title: string, description: string, "
    "url: string, urlToImage: string, publishedAt: string, content: string>>"
)
# Keys of the ratings file and the columns they become.
RATING_KEYS = {
    "Source": "source_name",
    "MBFC URL": "rating_url",
    "Bias": "bias",
    "Country": "country",
    "Factual Reporting": "factual_reporting",
    "Media Type": "media_type",
    "Source URL": "source_url",
    "Credibility": "credibility",
}
RATING_ID_KEY = "Source ID#"


def parse_feed_date(c: Column) -> Column:
    """RFC 822 date; weekday and seconds are optional, the year may have two digits, the zone is a name or an offset.

    ISO dates, which Atom and RDF use, are read as well.
    """
    text = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""))
    forms = [f"d MMM {year} {clock} {zone}" for year in ("yyyy", "yy") for clock in ("HH:mm:ss", "HH:mm") for zone in ("z", "Z")]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in forms], parse_iso_utc(c))


def _known_entities(text: Column) -> Column:
    """Named HTML entities become numbers, and an ampersand that begins none is escaped."""
    numbers = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() if name not in _XML_NAMES for x in (name, f"&#{code};")])

    def healed(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);", 1)
        kept = F.concat(F.lit("&"), part)
        number = F.element_at(numbers, name)
        return (
            F.when(name == "", F.concat(F.lit("&amp;"), part))
            .when(name.startswith("#") | name.isin(*_XML_NAMES), kept)
            .when(number.isNotNull(), F.concat(number, F.substr(part, F.length(name) + 2)))
            .otherwise(F.concat(F.lit("&amp;"), part))
        )

    return F.array_join(F.transform(F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(healed(part))), "")


def heal_entities(xml: Column) -> Column:
    """Make entities that only HTML defines readable as XML; character data sections stay as they are."""
    opening, closing = "<![CDATA[", "]]>"

    def section(part: Column, i: Column) -> Column:
        end = F.instr(part, closing)
        outside = F.when(end > 0, F.concat(F.substr(part, F.lit(1), end + 2), _known_entities(F.substr(part, end + 3)))).otherwise(part)
        return F.when(i == 0, _known_entities(part)).otherwise(outside)

    whole = F.array_join(F.transform(F.split(xml, r"<!\[CDATA\["), section), opening)
    return F.when(F.contains(xml, F.lit("&")), whole).otherwise(xml)


def _feeds(feeds: DataFrame) -> DataFrame:
    clean = F.regexp_replace("xml", "^\ufeff", "")
    # A root with a prefix (as in <atom:feed>) makes that prefix the one of the core elements.
    prefix = F.regexp_extract(clean, _FEED_PREFIX, 1)
    plain = F.when(prefix == "", clean).otherwise(F.regexp_replace(clean, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1")))
    feeds = feeds.select("endpoint_id", heal_entities(plain).alias("xml"))
    clean = F.col("xml")
    return feeds.select("endpoint_id", clean.alias("xml"), F.from_xml(clean, FEED_SCHEMA, _FEED_OPTIONS).alias("f"))


def _broken() -> Column:
    root = F.regexp_extract("xml", _FEED_ROOT, 1)
    closed = F.col("xml").rlike(r"(?s)(</(?:\w+:)?(rss|feed|RDF)\s*>|<(?:\w+:)?(rss|feed|RDF)[^>]*/>)\s*(<!--.*?-->\s*)*$")
    return (
        F.when(is_blank("xml"), F.lit("feed is empty"))
        .when(root == "", F.lit("not a feed"))
        .when(F.col("f").isNull() | F.col("f._broken").isNotNull() | ~closed, F.lit("feed is not well-formed"))
    )


def feed_rejects(feeds: DataFrame) -> DataFrame:
    """``(endpoint_id, reject_reason)`` of the feeds that :func:`parse_rss` can't read."""
    return _feeds(feeds).select("endpoint_id", _broken().alias("reject_reason")).filter("reject_reason is not null")


def parse_rss(feeds: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per entry of ``feeds(endpoint_id, xml)``, which may be RSS, RDF or Atom.

    Only core elements make an entry: those of other vocabularies (``media:title``, ``atom:link``, ``itunes:author``)
    don't stand in for them, but for ``dc:date`` and ``content:encoded`` where the core ones are missing. HTML entities
    and bare ampersands are read as text. Entries without link or title are dropped; feeds that can't be read are listed by
    :func:`feed_rejects`.
    """
    stamp = F.current_timestamp() if now is None else now
    parsed = _feeds(feeds).filter(_broken().isNull())
    plain = F.transform(F.coalesce("f.channel.item", "f.item"), lambda i: F.struct(
        i["title"].alias("title"), i["link"].alias("link"), F.coalesce(i["guid"], i["link"]).alias("id"),
        F.coalesce(i["description"], i["content:encoded"]).alias("text"), F.coalesce(i["pubDate"], i["dc:date"]).alias("date")))
    main = lambda links: F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    atom = F.transform("f.entry", lambda i: F.struct(
        i["title"].alias("title"), main(i["link"]).alias("link"), F.coalesce(i["id"], main(i["link"])).alias("id"),
        F.coalesce(i["summary"], i["content"]).alias("text"), F.coalesce(i["published"], i["updated"]).alias("date")))
    items = parsed.select("endpoint_id", F.posexplode(F.coalesce(plain, atom)).alias("pos", "i"))
    return items.filter(F.col("i.link").isNotNull() & ~is_blank(F.col("i.title"))).select(
        "endpoint_id",
        "pos",
        F.col("i.id").alias("source_item_id"),
        F.col("i.link").alias("external_url"),
        F.col("i.title").alias("title"),
        F.coalesce(F.col("i.text"), F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("raw_text"),
        F.coalesce(parse_feed_date(F.col("i.date")), stamp).alias("published_date"),
    )


def api_endpoints(endpoints: DataFrame, provider: str = PROVIDER) -> DataFrame:
    """Enabled API endpoints of the provider that name a source."""
    return endpoints.filter(
        F.col("enabled") & (F.col("kind") == "API") & (F.lower("api_provider") == provider) & ~is_blank("api_query")
    )


def plan_api_batches(endpoints: DataFrame, counts: DataFrame, max_sources: int = MAX_SOURCES,
                     provider: str = PROVIDER) -> DataFrame:
    """``(batch, endpoint_id, source_id, is_owner, rank)``: endpoints by article volume, cut into batches.

    A source id named by several endpoints belongs to the first of them.
    """
    due = api_endpoints(endpoints, provider).select(
        F.col("id").alias("endpoint_id"), lower_or("api_query").alias("source_id")
    )
    counted = due.join(counts, "endpoint_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = volume_rank(counted, "n", "endpoint_id")
    owners = ranked.groupBy("source_id").agg(F.min("rank").alias("_owner"))
    return ranked.join(owners, "source_id").select(
        F.floor((F.col("rank") - 1) / max_sources).alias("batch"),
        "endpoint_id",
        "source_id",
        (F.col("rank") == F.col("_owner")).alias("is_owner"),
        "rank",
    )


def batch_requests(planned: DataFrame) -> DataFrame:
    """The ``sources`` parameter of each batch: its distinct ids in rank order.

    A batch holds at most ``max_sources`` rows, which bounds the collected list.
    """
    first = planned.groupBy("batch", "source_id").agg(F.min("rank").alias("rank"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "source_id")))
    return first.groupBy("batch").agg(
        F.array_join(F.transform(listed, lambda r: r["source_id"]), ",").alias("sources"),
        F.count("*").alias("n_sources"),
    )


def pages_in_budget(pages: DataFrame, n_articles: str = "n_articles", page_size: int = PAGE_SIZE,
                    max_pages: int = MAX_PAGES, max_requests: int = MAX_REQUESTS) -> DataFrame:
    """Landed pages a run would have asked for.

    Per batch, pages up to and including the first short one, at most ``max_pages``; over all, the
    first ``max_requests`` in (batch, page) order. The overall cut is a top-k, not a global sort.
    """
    in_range = pages.filter(F.col("page").between(1, max_pages))
    short = F.when(F.coalesce(F.col(n_articles), F.lit(0)) < page_size, F.col("page"))
    stops = in_range.groupBy("batch").agg(F.min(short).alias("_stop"))
    kept = in_range.join(stops, "batch").filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    return kept.drop("_stop").orderBy("batch", "page").limit(max_requests)


def api_page_rejects(pages: DataFrame) -> DataFrame:
    """Pages whose status is not 'ok', with the message the API gave."""
    parsed = pages.withColumn("r", F.from_json("json", API_SCHEMA))
    return parsed.filter(~F.coalesce(F.col("r.status") == "ok", F.lit(False))).select(
        "batch", "page", F.col("r.code").alias("code"), F.col("r.message").alias("message")
    )


def flatten_api_pages(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """Articles of ``pages(batch, page, json)`` as feed items of the endpoint that owns their source.

    Only sources owned by an endpoint of the page's own batch count. The first row of a URL per endpoint and batch wins.
    ``pos`` counts on over the pages of a batch, so it is one order per endpoint.
    """
    parsed = pages.select("batch", "page", F.from_json("json", API_SCHEMA).alias("r")).filter("r.status = 'ok'")
    rows = parsed.select("batch", "page", F.posexplode("r.articles").alias("pos", "a")).select(
        "batch", "page", "pos", lower_or(F.col("a.source.id")).alias("source_id"), "a.url", "a.title",
        "a.description", "a.publishedAt",
    )
    rows = rows.filter(F.col("source_id").isNotNull() & ~is_blank("url") & ~is_blank("title"))
    owner = planned.filter("is_owner").select("batch", "source_id", "endpoint_id")
    mapped = rows.join(owner, ["batch", "source_id"])
    first = keep_first(mapped, ["endpoint_id", "batch", "url"], [F.asc("page"), F.asc("pos")])
    return first.select(
        "endpoint_id",
        "batch",
        "page",
        ((F.col("page") - 1) * PAGE_STEP + F.col("pos")).cast("int").alias("pos"),
        F.col("url").alias("source_item_id"),
        F.col("url").alias("external_url"),
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("raw_text"),
        parse_iso_utc("publishedAt").alias("published_date"),
    )


def _rating_columns(row: str) -> list[Column]:
    named = [F.col(f"{row}.`{key}`").alias(name) for key, name in RATING_KEYS.items()]
    return [F.col(f"{row}.`{RATING_ID_KEY}`").alias("rating_id"), *named]


def _rating_struct() -> str:
    fields = ", ".join(f"`{key}`: string" for key in RATING_KEYS)
    return f"struct<{fields}, `{RATING_ID_KEY}`: bigint>"


def parse_ratings(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Rating entries of landed response bodies: a JSON array per body, byte order mark dropped."""
    text = F.regexp_replace(F.col(body), "^﻿", "")
    entries = F.from_json(text, f"array<{_rating_struct()}>")
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, F.posexplode(entries).alias("pos", "e")).select(*others, "pos", *_rating_columns("e"))


def rating_rejects(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that are no JSON array of entries, with a reason."""
    text = F.regexp_replace(F.col(body), "^\ufeff", "")
    others = [c for c in bodies.columns if c != body]
    reason = F.when(is_blank(text), "body is empty").when(F.from_json(text, f"array<{_rating_struct()}>").isNull(), "not a JSON array of ratings")
    return bodies.select(*others, reason.alias("reject_reason")).filter("reject_reason is not null")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rating files on disk: JSON arrays of objects, unknown keys ignored."""
    bodies = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return parse_ratings(bodies)
