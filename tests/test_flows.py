"""Feeds, discovery, runs, endpoint state, catalog and evidence views on literal cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsevidence import schemas
from newsevidence.operators import catalog as C
from newsevidence.operators import discover as D
from newsevidence.operators import evidence as E
from newsevidence.operators import keyed as K
from newsevidence.operators import runs as R
from newsevidence.operators import views as V
from newsevidence.sources import chunks as SC
from newsevidence.sources import feeds as S
from newsevidence.sources import responses as P
from newsevidence.sources.tables import read_table, stage, write_snapshot

NOW_TEXT = "2024-06-01 12:00:00"
NOW_TIME = datetime(2024, 6, 1, 12)


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


# Feeds -----------------------------------------------------------------------------------------

def test_rss(spark):
    item = lambda *parts: "<item>" + "".join(parts) + "</item>"
    xml = "<rss><channel><title>f</title>" + item(
        "<title>T1</title><link>https://e.com/article-1</link><description>desc1</description>"
        "<pubDate>Wed, 18 Dec 2024 10:00:00 GMT</pubDate>"
    ) + item("<title>T2</title><link>https://e.com/article-2</link><description></description>") + item(
        "<title> </title><link>https://e.com/3</link>"
    ) + item("<title>no link</title>") + item(
        "<title>T5</title><link>https://e.com/5</link><guid isPermaLink='false'>g5</guid>"
        "<pubDate>18 Dec 2024 10:00:00 +0200</pubDate>"
    ) + "</channel></rss>"
    got = S.parse_rss(spark.createDataFrame([(7, xml)], "endpoint_id long, xml string"), now()).orderBy("pos").collect()
    assert [(r.source_item_id, r.description, r.published_date) for r in got] == [
        ("https://e.com/article-1", "desc1", datetime(2024, 12, 18, 10)), ("https://e.com/article-2", "", NOW_TIME),
        ("g5", "", datetime(2024, 12, 18, 8)),
    ]
    assert got[0].raw_text is None


def test_atom_rdf_and_odd_dates(spark):
    atom = ("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title>f</title><entry><title type='html'>A</title>"
            "<link rel='self' href='https://e.com/self'/><link href='https://e.com/a'/><id>tag:a</id><summary>s</summary>"
            "<updated>2024-12-18T10:00:00Z</updated></entry></feed>")
    rdf = ("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns:dc='http://purl.org/dc/elements/1.1/'>"
           "<channel><title>f</title></channel><item><title>R</title><link>https://e.com/r</link><dc:date>2024-12-18T11:00:00Z</dc:date>"
           "</item></rdf:RDF>")
    rss = ("<rss><channel><item><title>S</title><link>https://e.com/s</link><pubDate>Wed, 18 Dec 24 10:00 GMT</pubDate></item>"
           "<item><title>T</title><link>https://e.com/t</link><pubDate>18 Dec 2024 12:30 +0000</pubDate></item></channel></rss>")
    feeds = spark.createDataFrame([(1, atom), (2, rdf), (3, rss), (4, rss[:-20]), (5, "<html><body/></html>"), (6, " "), (7, None),
                                   (8, "<rss><channel/></rss>")], "endpoint_id long, xml string")
    got = rows(S.parse_rss(feeds, now()), "endpoint_id", "source_item_id", "external_url", "title", "description", "published_date")
    assert got == [
        (1, "tag:a", "https://e.com/a", "A", "s", datetime(2024, 12, 18, 10)), (2, "https://e.com/r", "https://e.com/r", "R", "", datetime(2024, 12, 18, 11)),
        (3, "https://e.com/s", "https://e.com/s", "S", "", datetime(2024, 12, 18, 10)), (3, "https://e.com/t", "https://e.com/t", "T", "", datetime(2024, 12, 18, 12, 30)),
    ]
    assert rows(S.feed_rejects(feeds), "endpoint_id", "reject_reason") == [
        (4, "feed is not well-formed"), (5, "not a feed"), (6, "feed is empty"), (7, "feed is empty")]


def test_unreadable_ratings_are_listed(spark):
    bodies = spark.createDataFrame([(1, "[]"), (2, "{broken"), (3, ""), (4, None)], "id long, body string")
    assert rows(S.rating_rejects(bodies), "id", "reject_reason") == [(2, "not a JSON array of ratings"), (3, "body is empty"), (4, "body is empty")]


ENDPOINT = "id long, enabled boolean, kind string, api_provider string, api_query string"


def test_api_batches_and_articles(spark):
    import json

    endpoints = spark.createDataFrame([
        (1, True, "API", "newsapi", "source-low"), (2, True, "API", "NewsAPI", " SOURCE-HIGH "),
        (3, True, "API", "newsapi", "Source-Mid"), (4, False, "API", "newsapi", "off"), (5, True, "API", "other", "x"),
        (6, True, "API", "newsapi", " "), (7, True, "RSS", None, None), (8, True, "API", "newsapi", "source-high"),
    ], ENDPOINT)
    counts = spark.createDataFrame([(1, 1), (2, 10), (3, 5)], "endpoint_id long, n long")
    plan = S.plan_api_batches(endpoints, counts, 2).cache()
    assert rows(S.batch_requests(plan), "batch", "sources") == [(0, "source-high,source-mid"), (1, "source-low,source-high")]
    assert rows(plan.filter("not is_owner"), "endpoint_id") == [(8,)]
    art = lambda src, url, title, at="2024-01-01T00:00:00Z": {"source": {"id": src}, "url": url, "title": title, "publishedAt": at}
    page = lambda arts, status="ok": json.dumps({"status": status, "articles": arts, "code": "c", "message": "m"})
    pages = spark.createDataFrame([
        (0, 1, page([art("Source-High", "https://a1", "Title A1"), art("source-high", "https://a1", "again"),
                     art("source-mid", "https://b1", "B", "bad"), art("source-low", "https://x", "not this batch"),
                     art(None, "https://y", "t"), art("source-mid", " ", "t"), art("source-mid", "https://z", " ")])),
        (0, 2, page([art("source-high", "https://a1", "late"), art("source-high", "https://a2", "A2")])),
        (1, 1, page([], "error")),
    ], "batch long, page int, json string")
    got = rows(S.flatten_api_pages(pages, plan), "endpoint_id", "external_url", "title", "published_date", "description")
    assert got == [(2, "https://a1", "Title A1", datetime(2024, 1, 1), ""), (2, "https://a2", "A2", datetime(2024, 1, 1), ""),
                   (3, "https://b1", "B", None, "")]
    assert rows(S.api_page_rejects(pages), "batch", "code") == [(1, "c")]


def test_page_budget(spark):
    pages = spark.createDataFrame([(0, 1, 100), (0, 2, 50), (0, 3, 100), (1, 1, 0), (1, 2, 100), (2, 6, 100), (2, 1, 100)],
                                  "batch long, page int, n_articles int")
    assert rows(S.pages_in_budget(pages), "batch", "page") == [(0, 1), (0, 2), (1, 1), (2, 1)]
    assert S.pages_in_budget(pages, max_requests=1).count() == 1


def test_ratings_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('﻿[{"Source": "ItemFix", "MBFC URL": "u", "Source ID#": 104914, "Other": 1}]', encoding="utf-8")
    (tmp_path / "e.json").write_text("﻿[]", encoding="utf-8")
    assert rows(S.read_ratings(spark, str(tmp_path)), "rating_id", "source_name", "rating_url") == [(104914, "ItemFix", "u")]


# Responses -------------------------------------------------------------------------------------

def test_hits(spark):
    import json

    hit = lambda d, **kw: {"text": "t", "articleTitle": "T", "sourceName": "s", "articleId": 5, "publishedDate": "2024-01-02T03:04:05Z",
                           "articleUrl": " ", "mbfcBias": "", "_additional": {"distance": d}, **kw}
    body = lambda hits, **kw: json.dumps({"data": {"Get": {"ArticleChunk": hits}}, **kw})
    df = spark.createDataFrame([
        (1, body([hit(0.3), hit(0.9)])), (2, body([hit(0.1)], errors=[{"message": "x"}])),
        (3, body([{"articleId": 0}])), (4, "not json"),
    ], "query_id long, json string")
    got = P.parse_hits(df, 0.5).collect()
    assert [(r.query_id, r.article_id, r.article_url, r.bias, r.published_date) for r in got] == [
        (1, 5, None, None, datetime(2024, 1, 2, 3, 4, 5))]
    third = P.parse_hits(df).filter("query_id = 3").first()
    assert (third.distance, third.article_id, third.text, third.title) == (1.0, None, "", "")
    assert rows(P.hit_rejects(df), "query_id") == [(2,), (4,)]


def test_model_responses(spark):
    df = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"hi"}]}}]}',), ("{}",)], "body string")
    assert [r.answer for r in P.model_text(df).collect()] == ["hi", P.NO_TEXT + "{}"]
    df = spark.createDataFrame([('{"predictions":[{"embeddings":{"values":[1,2.5]}}]}',), ("{}",)], "body string")
    assert [(r.vector, r.reject_reason) for r in P.model_vector(df).collect()] == [([1.0, 2.5], None), (None, "no embedding values")]


# Keyed -----------------------------------------------------------------------------------------

def test_upsert_policies(spark):
    schema = "id long, a string, version int, created_at timestamp, updated_at timestamp"
    old = datetime(2020, 1, 1)
    cur = spark.createDataFrame([(1, "x", 0, old, old), (2, " ", 3, old, old), (3, "z", 0, old, old)], schema)
    new = spark.createDataFrame([(1, "y"), (2, "b"), (4, "n"), (3, "z")], "id long, a string")
    get = lambda p: rows(K.upsert(cur, new, ["id"], p, now=now(), action="act"), "id", "a", "version", "act", "updated_at")
    assert get("replace") == [(1, "y", 1, "updated", NOW_TIME), (2, "b", 4, "updated", NOW_TIME), (3, "z", 0, "kept", old),
                              (4, "n", 0, "inserted", NOW_TIME)]
    assert get("insert") == [(1, "x", 0, "kept", old), (2, " ", 3, "kept", old), (3, "z", 0, "kept", old), (4, "n", 0, "inserted", NOW_TIME)]
    assert get("fill") == [(1, "x", 0, "kept", old), (2, "b", 4, "updated", NOW_TIME), (3, "z", 0, "kept", old), (4, "n", 0, "inserted", NOW_TIME)]


def test_volume_rank_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "RANK_BUCKET", 10)
    df = spark.range(200).selectExpr("id", "id % 7 as n")
    want = sorted(((r.id, r.n) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    got = {r.id: r["rank"] for r in K.volume_rank(df, "n", "id").collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(want)}


def test_salted_join_keeps_every_row_once(spark):
    big = spark.range(1000).selectExpr("if(id < 900, 1, id) as k", "id as v")
    side = spark.range(1, 1000).selectExpr("id as k", "id * 2 as w")
    got = K.salted_join(big, side, ["k"], ["v"])
    assert got.count() == 1000 and got.filter("w <> k * 2").count() == 0


# Discovery -------------------------------------------------------------------------------------

ITEM = "endpoint_id long, pos int, source_item_id string, external_url string, title string, description string, raw_text string, published_date timestamp"


def discovery(spark):
    items = spark.createDataFrame([
        (1, 0, "i0", None, "t", "", None, None), (1, 1, "known", "https://a", "t", "", None, None),
        (1, 2, None, "https://b", "new", "", None, None), (1, 3, "i3", "https://b", "same url", "", None, None),
        (1, 4, "i4", "https://seen", "t", "", None, None), (1, 5, "i5", "https://x/video/1", "t", "", None, None),
        (1, 6, "i6", "https://x/video/2", "own", "", "text", None), (2, 7, "i7", "https://b", "other publisher", "", None, None),
        (1, 8, "i4", "https://seen2", "repeated item", "", None, None),
    ], ITEM)
    endpoints = spark.createDataFrame([(1, 10), (2, 20)], "id long, publisher_id long")
    articles = spark.createDataFrame([(5, 10, "https://seen")], "id long, publisher_id long, canonical_url string").select(
        "*", F.sha2("canonical_url", 256).alias("canonical_url_hash"), F.lit("INDEXED").alias("status"),
        F.lit("2020-01-01").cast("timestamp").alias("last_seen_at"))
    links = spark.createDataFrame([(5, 1, "known", NOW_TIME)], "article_id long, source_endpoint_id long, source_item_id string, fetched_at timestamp")
    return items, endpoints, articles, links


def test_discover_and_second_run(spark):
    items, endpoints, articles, links = discovery(spark)
    found = D.discover(items, endpoints, articles, links, now())
    assert rows(found.articles, "publisher_id", "canonical_url", "title", "is_new") == [
        (10, "https://b", "new", True), (10, "https://seen", "t", False), (10, "https://x/video/2", "own", True),
        (20, "https://b", "other publisher", True)]
    assert rows(found.links, "source_item_id", "is_new") == [
        ("https://b", True), ("i3", False), ("i4", False), ("i6", True), ("i7", True)]
    fresh = D.new_article_rows(articles, found.articles, now())
    merged = D.merge_articles(articles, fresh, D.seen_again(found.articles))
    assert sorted(r.id for r in merged.collect()) == [5, 6, 7, 8]
    assert {r.id: r.last_seen_at for r in merged.collect()}[5] == NOW_TIME
    stored = D.merge_links(links, D.new_link_rows(found.links, fresh))
    assert stored.filter("article_id is null").count() == 0
    again = D.discover(items, endpoints, merged, stored, now())
    assert again.articles.count() == 0 and again.links.count() == 0


def test_article_state(spark):
    arts = spark.createDataFrame([(i, "DISCOVERED") for i in range(1, 8)], "id long, status string")
    res = spark.createDataFrame([
        (1, "own", 500, "x", "y", None, NOW_TIME, None), (2, None, 404, None, None, None, NOW_TIME, None),
        (3, None, None, "Timeout", None, None, NOW_TIME, None), (4, None, 200, None, "Low", None, NOW_TIME, None),
        (5, None, 200, None, None, "  ", NOW_TIME, None), (6, None, 200, None, None, "t", NOW_TIME, "boom"),
    ], "article_id long, raw_text string, http_status int, fetch_error string, extraction_error string, extracted_text string, fetched_at timestamp, index_error string")
    chunks = spark.createDataFrame([(1, 2)], "article_id long, chunk_count int")
    got = {r.id: r for r in D.apply_article_state(arts, res, chunks).collect()}
    assert [(got[i].status, got[i].fetch_error or got[i].extraction_error) for i in range(1, 8)] == [
        ("INDEXED", None), ("ERROR", "HTTP status 404"), ("ERROR", "Timeout"), ("ERROR", "Low"),
        ("ERROR", "No meaningful text extracted"), ("ERROR", "Indexing failed: boom"), ("DISCOVERED", None)]
    assert (got[1].http_status, got[1].chunk_count, got[1].indexed) == (200, 2, True)


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    from newsevidence.streaming.discover import read_state, stream_discover

    items, endpoints, articles, links = discovery(spark)
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    for low, high in ((0, 2), (3, 5), (6, 8), (0, 8)):  # in feed order, then everything again
        items.filter(f"pos between {low} and {high}").coalesce(1).write.mode("append").parquet(landing)
    version = stream_discover(spark, landing, ITEM, lambda df: df, endpoints, state, (articles, links), now(), files_per_trigger=1)
    assert version == 4
    got_articles, got_links = read_state(spark, state, version)
    found = D.discover(items, endpoints, articles, links, now())
    fresh = D.new_article_rows(articles, found.articles, now())
    want = D.merge_articles(articles, fresh, D.seen_again(found.articles))
    cols = ("publisher_id", "canonical_url")
    assert rows(got_articles, *cols) == rows(want, *cols)
    assert {r.id: r.last_seen_at for r in got_articles.collect()}[5] == NOW_TIME
    # A restart goes on where the stream stopped: nothing new leaves the version, new files move it.
    again = lambda: stream_discover(spark, landing, ITEM, lambda df: df, endpoints, state, (articles, links), now())
    assert again() == 4
    items.limit(1).coalesce(1).write.mode("append").parquet(landing)
    assert again() == 5 and read_state(spark, state, 5)[0].count() == got_articles.count()
    keys = {(r.source_endpoint_id, r.source_item_id) for r in got_links.collect()}
    assert keys == {(r.source_endpoint_id, r.source_item_id) for r in D.merge_links(links, D.new_link_rows(found.links, fresh)).collect()}
    assert got_links.count() == len(keys)


def test_stream_state_is_compacted(spark, tmp_path, monkeypatch):
    from newsevidence.streaming import discover as stream

    monkeypatch.setattr(stream, "COMPACT_AFTER", 3)
    items, endpoints, articles, links = discovery(spark)
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")
    run = lambda: stream.stream_discover(spark, landing, ITEM, lambda df: df, endpoints, state, (articles, links), now(), files_per_trigger=1)
    for low, high in ((0, 1), (2, 3), (4, 5), (6, 7), (8, 8), (0, 8), (3, 8)):
        items.filter(f"pos between {low} and {high}").coalesce(1).write.mode("append").parquet(landing)
        if low == 4:
            assert run() == 3
    assert run() == 7
    found = D.discover(items, endpoints, articles, links, now())
    fresh = D.new_article_rows(articles, found.articles, now())
    got_articles, got_links = stream.read_state(spark, state, 7)
    cols = ("publisher_id", "canonical_url")
    assert rows(got_articles, *cols) == rows(D.merge_articles(articles, fresh, D.seen_again(found.articles)), *cols)
    assert got_links.count() == D.merge_links(links, D.new_link_rows(found.links, fresh)).count()
    for name in ("articles", "links", "seen"):
        assert sorted(p.name for p in (tmp_path / "state" / name).iterdir() if p.is_dir()) == ["v=7"]
        assert sorted(p.name for p in (tmp_path / "state" / f"base_{name}").iterdir() if p.is_dir()) == ["v=6"]
    assert not [p for p in (tmp_path / "state" / "work").iterdir() if p.is_dir()]


def test_history_is_scanned_but_not_shuffled(spark, tmp_path, monkeypatch):
    from newsevidence.operators import history as H

    spark.range(2000).selectExpr("id as article_id", "id % 7 as source_endpoint_id", "concat('item', id) as source_item_id").write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    batch = spark.createDataFrame([(i % 7, f"item{i}", "u") for i in range(1990, 2010)] + [(None, "x", "u")], "endpoint_id long, source_item_id string, url string")
    keys = {"source_endpoint_id": "endpoint_id", "source_item_id": "source_item_id"}
    met = H.touched_history(links, batch, keys)
    assert met.count() == 10 and met.columns == links.columns
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange") + 1  # the keys' own
    new = lambda: sorted(r.source_item_id for r in D.new_items(batch, links).collect())
    want = sorted([f"item{i}" for i in range(2000, 2010)] + ["x"])
    assert new() == want
    assert H.touched_history(links, batch, keys, most_bytes=64).count() == 2000  # a batch past the bound: left to the join
    assert H.touched_history(links, batch.limit(0), keys).count() == 0


# Runs ------------------------------------------------------------------------------------------

LOG = "run_id long, status string, error_details string, completed_at timestamp"


@pytest.mark.parametrize("logs, want", [
    ([("SUCCESS", None), ("FAILED", "Robots.txt disallows scraping for this source")], "COMPLETED"),
    ([("SUCCESS", None), ("FAILED", "HTTP 500")], "PARTIAL"), ([("SKIPPED", None)], "FAILED"),
    ([("PARTIAL", None)], "PARTIAL"), ([("FAILED", "x")], "FAILED"), ([("SUCCESS", None), ("SKIPPED", None)], "COMPLETED"),
])
def test_rollup(spark, logs, want):
    df = spark.createDataFrame([(1, s, e, NOW_TIME) for s, e in logs] + [(2, "SUCCESS", None, None)], LOG)
    assert rows(R.run_rollup(df), "run_id", "status") == [(1, want)]


def endpoint(**kw):
    base = dict(id=1, block_count=0, block_reason=None, blocked_until=None, failure_count=2, robots_disallowed=False,
                last_attempted_at=None, last_fetched_at=None, last_success_at=None, updated_at=None)
    return {**base, **kw}


ENDPOINT_STATE = ("id long, block_count int, block_reason string, blocked_until timestamp, failure_count int, robots_disallowed boolean, "
                  "last_attempted_at timestamp, last_fetched_at timestamp, last_success_at timestamp, updated_at timestamp")
ITEMS = "run_id long, endpoint_id long, pos long, skipped boolean, is_new boolean, success boolean, indexed boolean, reason string"
FETCH = "run_id long, endpoint_id long, fetched long, fetch_error string, sample_url string, sample_allowed boolean"
GOOD, BLOCK, EXTRACT, ROBOTS, FAILED = ("good", "BLOCKED_OR_CAPTCHA", "EXTRACTION_FAILED", "ROBOTS_DISALLOWED", "failed")


def attempt(spark, items, threshold=2, fetch=(None, None, None), **state):
    item = lambda i, x: (1, 1, i, False, True, x == GOOD, x == GOOD, x if x not in (GOOD, FAILED) else None)
    eps = spark.createDataFrame([endpoint(**state)], ENDPOINT_STATE)
    its = spark.createDataFrame([item(i, x) for i, x in enumerate(items)], ITEMS)
    fetches = spark.createDataFrame([(1, 1, len(items), *fetch)], FETCH)
    attempts = R.endpoint_attempt(fetches, eps, its, now())
    after = R.update_endpoint_state(eps, attempts, now(), threshold)
    return attempts.first(), after.first()


def test_attempt_stops_at_a_block_and_counts_it(spark):
    a, e = attempt(spark, [GOOD, BLOCK, GOOD, GOOD])
    assert (a.status, a.articles_processed, a.articles_failed) == ("PARTIAL", 1, 1)
    assert (e.block_count, e.block_reason, e.blocked_until, e.failure_count) == (1, BLOCK, None, 3)
    assert e.last_fetched_at == NOW_TIME and e.last_success_at is None


def test_block_starts_at_the_threshold(spark):
    a, e = attempt(spark, [BLOCK], block_count=1)
    assert a.status == "FAILED"
    assert (e.block_count, e.blocked_until) == (2, NOW_TIME + timedelta(hours=24)) and e.last_fetched_at is None


def test_extraction_failures_count_only_without_success(spark):
    _, e = attempt(spark, [EXTRACT, EXTRACT], threshold=1)
    assert (e.block_count, e.block_reason) == (1, EXTRACT) and e.blocked_until is not None
    _, e = attempt(spark, [EXTRACT, GOOD], block_count=1, block_reason="old")
    assert (e.block_count, e.block_reason) == (1, "old")


def test_success_clears_and_robots_flags(spark):
    a, e = attempt(spark, [GOOD, FAILED], block_count=1, block_reason="old")
    assert (a.status, e.block_count, e.block_reason, e.failure_count) == ("PARTIAL", 0, None, 3)
    a, e = attempt(spark, [GOOD], block_count=1, block_reason="old")
    assert (a.status, e.failure_count, e.last_success_at) == ("SUCCESS", 0, NOW_TIME)
    _, e = attempt(spark, [EXTRACT, ROBOTS, GOOD], block_count=1)
    assert (e.robots_disallowed, e.block_count, e.block_reason, e.blocked_until) == (True, 0, ROBOTS, None)


def test_precheck_outcomes(spark):
    a, e = attempt(spark, [GOOD], robots_disallowed=True)
    assert (a.status, a.error_details, a.articles_fetched) == ("SKIPPED", R.ROBOTS_SOURCE, 0)
    assert e.last_attempted_at == NOW_TIME and e.last_fetched_at is None and e.failure_count == 2
    a, _ = attempt(spark, [GOOD], blocked_until=NOW_TIME + timedelta(hours=1))
    assert (a.status, a.error_details) == ("SKIPPED", "Source blocked until 2024-06-01T13:00:00Z")
    a, e = attempt(spark, [GOOD], fetch=("boom", None, None))
    assert (a.status, a.error_details, e.failure_count, e.last_fetched_at) == ("FAILED", "Fetch error: boom", 3, None)
    a, e = attempt(spark, [GOOD], fetch=(None, "https://x/1", False), block_count=1)
    assert (a.status, a.articles_fetched, a.articles_processed) == ("SKIPPED", 1, 0)
    assert (e.robots_disallowed, e.block_count, e.last_fetched_at, e.failure_count) == (True, 0, NOW_TIME, 2)
    a, e = attempt(spark, [])
    assert (a.status, e.failure_count, e.last_success_at) == ("SUCCESS", 0, NOW_TIME)


def test_timeouts():
    hours = lambda h: timedelta(hours=h)
    assert [R.clamp_timeout(t) for t in (None, hours(0), hours(-1), hours(3), hours(99))] == [hours(6), hours(6), hours(6), hours(3), hours(24)]


# Catalog ---------------------------------------------------------------------------------------

def test_mapping(spark):
    entries = spark.createDataFrame([(0, 104914, "ItemFix", "https://itemfix.com"), (1, 107142, "MG", "montrealgazette.com"),
                                     (2, None, "x", "x.com"), (3, 104914, "again", "y.com")],
                                    "pos int, rating_id long, source_name string, source_url string")
    for c in ("rating_url", "bias", "country", "factual_reporting", "media_type", "credibility"):
        entries = entries.withColumn(c, F.lit(" "))
    ratings = C.sync_ratings(entries, spark.createDataFrame([], schemas.RATINGS), now())
    assert rows(ratings, "rating_id", "source_name", "source_url_domain", "bias") == [
        (104914, "ItemFix", "itemfix.com", None), (107142, "MG", "montrealgazette.com", None)]
    publishers = spark.createDataFrame([(1, "https://itemfix.com", None), (2, "https://montrealgazette.com", None), (3, "itemfix.com", 9),
                                        (4, None, None)], "id long, website_url string, rating_id long")
    mapping = C.map_publishers(publishers, ratings)
    assert rows(mapping, "id", "rating_id") == [(1, 104914), (2, 107142)]
    assert C.rating_sync_counts(entries, mapping).first().asDict() == {"fetched": 4, "saved": 2, "mapped": 2}
    assert rows(C.apply_mapping(publishers, mapping, now()), "id", "rating_id") == [(1, 104914), (2, 107142), (3, 9), (4, None)]


def test_source_sync_counts(spark):
    cat = spark.createDataFrame([(0, "a", "New", None, None), (1, "b", "NEW ", "us", None), (2, "b", "new", "de", "https://n"),
                                 (3, None, "x", "us", "u"), (4, "c", "Old", "gb", "https://o"), (5, "d", "old", "fr", None)],
                                "pos int, source_id string, name string, country string, url string")
    pubs = spark.createDataFrame([(1, "OLD", " ", None)], "id long, name string, country_code string, website_url string")
    eps = spark.createDataFrame([(9, 1, "API", "newsapi", "c")], "id long, publisher_id long, kind string, api_provider string, api_query string")
    got = C.source_sync_counts(cat, pubs, eps).first().asDict()
    assert got == {"fetched": 6, "created_endpoints": 3, "enriched_publishers": 3, "existing": 3}
    after = C.sync_source_publishers(cat, pubs, now())
    assert rows(after, "name", "country_code", "website_url") == [("New", "US", "https://n"), ("OLD", "GB", "https://o")]


# Views -----------------------------------------------------------------------------------------

def test_paging_limits(spark):
    df = spark.range(50)
    assert [r.id for r in V.page_of(df, 2, 20).collect()] == list(range(40, 50))
    assert [r.id for r in V.page_after(df, 39, 5).collect()] == [40, 41, 42, 43, 44]
    assert V.page_totals(df).first().total_pages == 3
    for page, size in ((-1, 20), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            V.page_of(df, page, size)
    assert [V.clamp_limit(x) for x in (0, -3, 7, 999)] == [50, 50, 7, 200]


def test_owner_scope(spark):
    df = spark.createDataFrame([(1, "a", NOW_TIME), (2, "b", NOW_TIME)], "id long, owner_username string, created_at timestamp")
    assert V.owner_claims(df, "a").count() == 1 and V.owner_claims(df, "", True).count() == 2
    with pytest.raises(ValueError):
        V.owner_claims(df, " ")
    assert V.recent_claims(df, 0, "a").count() == 0


def test_evidence_groups(spark):
    hit = lambda rank, art, url, title, text: (1, rank, art, url, title, "s", None, text)
    df = spark.createDataFrame([
        hit(0, None, "https://u", "U", "a"), hit(1, 1, None, "A", "x" * 300), hit(2, 1, None, "A2", " b "), hit(3, None, None, "T", None),
        hit(4, 1, None, "A3", "c"), hit(5, 2, None, "B", "d"), hit(6, 2, None, "B", "e"),
    ], "claim_id long, rank int, article_id long, article_url string, title string, source_name string, published_date timestamp, text string")
    got = E.evidence_groups(df).orderBy("first_rank", "part").collect()
    assert [(r.title, r.grouped, r.chunk_count) for r in got] == [
        ("U", False, 1), ("A", True, 3), ("T", False, 1), ("B", False, 1), ("B", False, 1)]
    assert [(c.content[:1], c.show_toggle) for c in got[1].chunks] == [("x", True), ("b", False), ("c", False)]
    assert got[2].chunks[0].content == ""


def test_prompts(spark):
    claims = spark.createDataFrame([(1, "claim $1 {{EVIDENCE}}", None, None, "why?"), (2, "two", "true", "e", "q")],
                                   "claim_id long, claim_text string, verdict string, explanation string, question string")
    hits = spark.createDataFrame([(2, 1, "T", "s", NOW_TIME, "left", None, "high", "body"), (2, 0, " ", None, None, None, "mixed", None, "first")],
                                 "claim_id long, rank int, title string, source_name string, published_date timestamp, bias string, "
                                 "factual_reporting string, credibility string, text string")
    get = lambda t, kind, **kw: {r.claim_id: r.prompt for r in E.prompt_table(claims, hits, t, kind, **kw).collect()}
    lines = "MBFC(factual_reporting=mixed) | first\n\n---\n\nT | source=s | published=2024-06-01 | MBFC({}credibility=high) | body"
    got = get("{{TODAY}} {{EVIDENCE}}", "verdict", today=F.lit("2024-06-02").cast("date"))
    assert got == {1: "2024-06-02 (no evidence found)", 2: "2024-06-02 " + lines.format("")}
    assert get("{{VERDICT}} {{EVIDENCE}}", "bias") == {1: "unclear (no evidence found)", 2: "true " + lines.format("bias=left, ")}
    got = get("{{VERDICT}}|{{EXPLANATION}}|{{FOLLOWUP_QUESTION}}", "followup")
    assert got == {1: "unclear|(no explanation stored)|why?", 2: "true|e|q"}


# Chunk table and files -------------------------------------------------------------------------

def test_chunk_pairs_and_rewrites(spark):
    from pyspark.errors import PySparkException

    packed = spark.createDataFrame([(1, ["a", "b"], [[1.0], [2.0]]), (2, [], None)], "article_id long, chunks array<string>, vectors array<array<double>>")
    assert rows(SC.pair_chunks(packed), "article_id", "chunk_index", "text") == [(1, 0, "a"), (1, 1, "b")]
    bad = spark.createDataFrame([(1, ["a"], [[1.0], [2.0]])], packed.schema)
    with pytest.raises(PySparkException):
        SC.pair_chunks(bad).collect()
    schema = "chunk_id string, article_id long, text string"
    stored = spark.createDataFrame([("a0", 1, "old"), ("a1", 1, "left over"), ("b0", 2, "b")], schema)
    fresh = spark.createDataFrame([("a0", 1, "new")], schema)
    assert rows(SC.write_chunks(stored, fresh), "chunk_id", "text") == [("a0", "new"), ("a1", "left over"), ("b0", "b")]
    assert rows(SC.write_chunks(stored, fresh, replace_article=True), "chunk_id", "text") == [("a0", "new"), ("b0", "b")]
    notes = spark.createDataFrame([(1, "t", "x", " ", [1.0]), (2, "t", "x", "s", [])], "note_id long, title string, text string, source string, vector array<float>")
    made, rejects = SC.manual_rows(notes, now())
    assert rows(made, "chunk_id", "source_name", "article_id") == [("manual-1", "manual", 0)]
    assert rows(rejects, "note_id") == [(2,)]


def test_old_chunk_files_read_with_new_columns(spark, tmp_path):
    path = str(tmp_path / "chunks")
    spark.createDataFrame([("a", "x")], "chunk_id string, text string").write.parquet(path)
    assert rows(SC.read_chunks(spark, path), "chunk_id", "bias") == [("a", None)]
    spark.createDataFrame([("b", "y", "left")], "chunk_id string, text string, bias string").write.mode("append").parquet(path)
    assert rows(SC.read_chunks(spark, path), "chunk_id", "bias", "credibility") == [("a", None, None), ("b", "left", None)]


def test_snapshots_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a", "b", NOW_TIME)], schemas.CLAIM_FOLLOWUP)
    write_snapshot(df, str(tmp_path / "claim_followup.parquet"), cluster_by=["id"])
    assert read_table(spark, str(tmp_path), "claim_followup").collect() == df.collect()
    assert stage(df, str(tmp_path), "s").collect() == df.collect()


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, " "), (2, "b" * 11), (3, "ok"), (4, "x"), (4, "y"), (4, "z")], "r long, t string")
    got = rows(V.batch_reject_reasons(df, "r", "t", max_items=2, max_chars=10, max_total=10), "r", "reject_reason")
    assert got == [(1, "a text is empty"), (2, "a text is too long"), (3, None), (4, "too many texts in one request")]
    claim = lambda t: spark.createDataFrame([(t,)], "t string").select(V.claim_reject_reason("t")).first()[0]
    assert [claim(t) for t in (" ", "x" * 400, "x" * 401, None)] == ["claim is empty", None, "claim is too long", "claim is empty"]


def test_fill_sees_tabs_as_blank(spark):
    current = spark.createDataFrame([(1, "\t", "x"), (2, "kept", None)], "id int, a string, b string")
    changes = spark.createDataFrame([(1, "new", "y"), (2, "new", "y")], "id int, a string, b string")
    got = {r.id: (r.a, r.b) for r in K.upsert(current, changes, ["id"], "fill").collect()}
    assert got == {1: ("new", "x"), 2: ("kept", "y")}


def test_unique_groups_by_columns(spark):
    from newsevidence.operators.audit import unique

    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("x", "y"), ("x", "y")], "p string, q string")
    assert [(r.key, r.detail) for r in unique(rows, "t", "r", [F.col("p"), F.col("q")]).collect()] == [("x|y", "2")]


def test_rejected_patches_claim_nothing(spark):
    from newsevidence.operators.catalog import patch_publishers

    schema = "id bigint, name string, country_code string, website_url string, rating_id bigint"
    held = spark.createDataFrame([(1, "one", None, None, None), (2, "two", None, None, None)], schema)
    patches = spark.createDataFrame([(1, "same", None, None, -5), (2, "Same", None, None, None), (9, "other", None, None, None)], schema)
    ratings = spark.createDataFrame([(1,)], "rating_id bigint")
    kept, rejects = patch_publishers(held, patches, ratings, F.lit(None).cast("timestamp"))
    assert {r.id: r.name for r in kept.collect()} == {1: "one", 2: "Same"}
    assert {r.id: r.reject_reason for r in rejects.collect()} == {1: "rating not found", 9: "not found"}


def test_keys_and_ids_are_dealt_over_a_stated_number_of_parts(spark, monkeypatch):
    from newsevidence.operators import audit as U

    df = spark.range(1000).selectExpr("id", "id % 998 as k", "if(id % 7 = 0, null, id) as ref")
    found = U.unique(df, "t", "r", [F.col("k")])
    assert sorted((r["key"], r.detail) for r in found.collect()) == [("0", "2"), ("1", "2")]
    assert "hashpartitioning(_k0#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {U.PARTS}), REPARTITION_BY_NUM" in plan
    parent = spark.range(990).withColumnRenamed("id", "pid")
    few = U.foreign_key(df, "t", "ref", parent, "pid", "id")
    monkeypatch.setattr(U, "BROADCAST_ROWS", 10)
    many = U.foreign_key(df, "t", "ref", parent, "pid", "id")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count(f", {U.PARTS}), REPARTITION_BY_NUM") == 2
    want = sorted(str(i) for i in range(990, 1000) if i % 7)
    assert sorted(r["key"] for r in few.collect()) == sorted(r["key"] for r in many.collect()) == want


def test_keys_of_stored_vectors_are_made_once(spark, tmp_path, monkeypatch):
    from newsevidence.operators import vector_store as V

    made, log = V.dedup_hash, str(tmp_path / "calls")
    from newsevidence.functions.vectors import digest_matrix

    @F.udf("string")
    def noted(t):
        with open(log, "a") as f:
            f.write("x")
        return t

    monkeypatch.setattr(V, "dedup_hash", lambda c: F.coalesce(noted.asNondeterministic()(made(c)), F.lit("")))
    texts = spark.createDataFrame([(i, f"text {i % 30}") for i in range(40)] + [(99, None)], "id int, text string").coalesce(1)
    run = lambda df: V.embed_stored(df, str(tmp_path / "store"), text="text", model="m", embedder=lambda t: digest_matrix(t, 8), dim=8)
    assert run(texts.where("id < 20")).count() == 20
    open(log, "w").close()
    out = {r.id: r.vector for r in run(texts).collect()}
    assert len(open(log).read()) == 41  # a call per row
    assert len(out) == 41 and out[3] == out[33] and out[3] != out[4] and out[99] == [0.0] * 8
    assert spark.read.parquet(str(tmp_path / "store/vectors")).count() == 31
