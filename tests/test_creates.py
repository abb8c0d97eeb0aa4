"""Creates of publishers and endpoints, request by request."""

from datetime import datetime

from pyspark.sql import functions as F

from newsevidence import schemas
from newsevidence.operators.creates import create_endpoints, create_publishers

NOW = datetime(2024, 6, 1)
now = lambda: F.lit(NOW)
PUBLISHER = "pos long, name string, country_code string, website_url string, rating_id long"
ENDPOINT = ("pos long, publisher_id long, publisher_name string, country_code string, website_url string, kind string, display_name string, "
            "rss_url string, api_provider string, api_query string, enabled boolean, fetch_interval_minutes int")


def publishers(spark):
    old = datetime(2020, 1, 1)
    return spark.createDataFrame([(1, "Daily News", "US", None, None, old, old), (5, "Other", None, "o.example", None, old, old)], schemas.PUBLISHERS)


def endpoints(spark):
    names = [f.split(" ")[0] for f in schemas.SOURCE_ENDPOINTS.split(", ")]
    row = {"id": 9, "publisher_id": 1, "kind": "RSS", "rss_url": "http://a/feed", "enabled": True}
    return spark.createDataFrame([tuple(row.get(n) for n in names)], schemas.SOURCE_ENDPOINTS)


def test_publishers(spark):
    asked = [(1, " Fresh ", " DE ", " ", 7), (2, "FRESH", None, None, None), (3, "daily news", None, None, None), (4, " ", None, None, None),
             (5, "Bad", None, None, 99), (6, "bad", None, "b.example", None), (7, None, None, None, None)]
    ratings = spark.createDataFrame([(7,)], "rating_id long")
    made = create_publishers(publishers(spark), spark.createDataFrame(asked, PUBLISHER), ratings, now())
    got = {r.pos: (r.id, r.reject_reason) for r in made.results.collect()}
    assert {p: r for p, (_, r) in got.items()} == {1: None, 2: "publisher already exists", 3: "publisher already exists", 4: "name must not be blank",
                                                   5: "rating not found", 6: None, 7: "name must not be blank"}
    assert {got[1][0], got[6][0]} == {6, 7} and all(got[p][0] is None for p in (2, 3, 4, 5, 7))
    rows = {r.id: r for r in made.publishers.collect()}
    fresh = rows[got[1][0]]
    assert len(rows) == 4 and (fresh.name, fresh.country_code, fresh.website_url, fresh.rating_id, fresh.created_at) == ("Fresh", "DE", None, 7, NOW)
    none = spark.createDataFrame([], PUBLISHER)
    assert create_publishers(publishers(spark), none, ratings, now()).publishers.count() == 2


def test_endpoints(spark):
    rss = lambda pos, who, name, url, country=None, **o: (pos, who, name, country, None, "RSS", f"F{pos}", url, "p", "q", o.get("enabled"), o.get("minutes"))
    asked = [
        rss(1, 1, None, "http://a/feed"), rss(2, 1, None, "http://b/feed", "GB", minutes=60), rss(3, None, "DAILY news", "http://b/feed"),
        rss(4, None, "New One", "http://n/feed"), rss(5, None, " new one", "http://n/feed"), rss(6, None, "New one", "http://m/feed", "FR", enabled=False),
        rss(7, 77, "x", "http://x"), rss(8, None, " ", "http://x"), rss(9, None, "Never", " "),
        (10, 5, None, None, "new.example", "API", "A", "ignored", "newsapi", "q", None, None), (11, 5, None, None, None, "API", "A", None, "newsapi", None, None, None),
        (12, 5, None, None, None, "API", "A", None, " ", "q", None, None), (13, 5, None, None, None, None, "A", None, None, None, None, None),
        (14, 5, None, "IT", None, "API", "A", "other", "newsapi", "q", None, None),
    ]
    made = create_endpoints(endpoints(spark), publishers(spark), spark.createDataFrame(asked, ENDPOINT), now())
    got = {r.pos: (r.id, r.reject_reason) for r in made.results.collect()}
    assert {p: r for p, (_, r) in got.items() if r} == {
        1: "endpoint already exists", 3: "endpoint already exists", 5: "endpoint already exists", 7: "publisher not found", 8: "publisher_name is required",
        9: "rss_url is required", 11: "api_query is required", 12: "api_provider is required", 13: "kind is required", 14: "endpoint already exists"}
    assert sorted(got[p][0] for p in (2, 4, 6, 10)) == [10, 11, 12, 13]
    rows = {r.id: r for r in made.endpoints.collect()}
    two, six, ten = rows[got[2][0]], rows[got[6][0]], rows[got[10][0]]
    assert (two.publisher_id, two.fetch_interval_minutes, two.enabled, two.api_provider) == (1, 60, True, None)
    assert (six.fetch_interval_minutes, six.enabled, ten.rss_url, ten.api_query) == (30, False, None, "q")
    owners = {r.id: r for r in made.publishers.collect()}
    assert len(owners) == 3 and six.publisher_id == rows[got[4][0]].publisher_id == 6
    assert (owners[6].name, owners[6].country_code, owners[1].country_code, owners[1].updated_at) == ("New One", "FR", "GB", NOW)
    assert (owners[5].country_code, owners[5].website_url) == (None, "new.example")  # a rejected request changes nothing
    none = spark.createDataFrame([], ENDPOINT)
    assert create_endpoints(endpoints(spark), publishers(spark), none, now()).endpoints.count() == 1
