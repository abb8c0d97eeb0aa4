"""Page extraction, fetch results and robots rules on literal pages."""

import time

import pytest
from pyspark.sql import functions as F

from newsevidence.functions.text import LOW_QUALITY
from newsevidence.functions.web import BLOCKED_MESSAGE
from newsevidence.operators.pages import extract_pages, fetch_results, page_paragraphs, paragraphs
from newsevidence.operators.robots import agent_rules, host_key, robots_filter

LONG = [f"Paragraph number {i} " + "carries plenty of readable words for the reader " * 8 for i in range(5)]
LONG = [p.strip() for p in LONG]


def p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_article_drops_short_and_link_paragraphs(spark):
    html = f"<html><body><article><p>short</p><p><a href='x'>{'link words ' * 10}</a></p>{p(LONG)}</article></body></html>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    row = extract_pages(df).first()
    assert row.n_paragraphs == 5 and row.extracted_text == "\n\n".join(LONG) and row.extraction_error is None


def test_best_div_when_no_article(spark):
    html = f"<body><div id=a>{p(['tiny words here'] * 3)}</div><div id=b>{p(LONG)}</div></body>"
    assert page_paragraphs(html) == LONG


def test_container_order():
    body = f"<main>{p(LONG[:1])}</main><div itemprop=articleBody>{p(LONG[1:2])}</div>"
    assert page_paragraphs(body) == LONG[1:2]
    assert page_paragraphs(f"<main>{p(LONG[:1])}</main><p>{LONG[2]}</p>") == LONG[:1]
    assert page_paragraphs(f"<p>{LONG[2]}</p>") == [LONG[2]]
    assert page_paragraphs("") == []


def test_boilerplate_rules(spark):
    html = (
        f"<article><nav>{p(LONG[:1])}</nav><footer>{p(LONG[:1])}</footer><p class=Promo-Box>{LONG[1]}</p>"
        f"<p id=newsletter>{LONG[1]}</p><p>{LONG[2]}</p><p>{LONG[2]}</p><dialog>{p(LONG[3:4])}</dialog>"
        f"<button><p>{LONG[3]}</p></button><p>Please accept cookies to go on reading this long page</p>"
        f"<p>Subscribe to read more of what we have to say about it</p></article>"
    )
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(paragraphs("html")).first()[0] == [LONG[2]]


def test_malformed_markup():
    html = (
        "<!DOCTYPE html><head><title>t</title><script>var t=\"</p>\";</script></head><body><article>"
        f"<p><b>{LONG[0]}<br><p>{LONG[1]} &amp; more<ul><li>one<li><p>{LONG[2]}</ul></article>"
    )
    assert page_paragraphs(html) == [LONG[0], LONG[1] + " & more", LONG[2]]


def test_deep_containers_pay_a_penalty():
    inner = p(["x" * 60] * 3)
    assert page_paragraphs(f"<div><section><div>{inner}</div></section></div>") == ["x" * 60] * 3
    deep = "<div>" * 12 + p(["y" * 60] * 3) + "</div>" * 12
    flat = f"<section>{p(['z' * 45] * 3)}</section>"
    assert page_paragraphs(deep + flat)[0][0] == "y"  # the outer div is shallow and holds the same paragraphs


@pytest.mark.parametrize("status, kind, body, error, type_error, blocked", [
    (200, "application/pdf", "x", None, "Non-HTML contentType: application/pdf", False),
    (403, "text/html", "please verify you are human", BLOCKED_MESSAGE, None, True),
    (503, "text/html", None, BLOCKED_MESSAGE, None, True),
    (404, "text/html", "plain", "HTTP status 404", None, False),
    (200, "text/html", "<p>too little</p>", None, LOW_QUALITY, False),
    (200, "text/html", f"<article>{p(LONG)}</article>", None, None, False),
])
def test_fetch_results(spark, status, kind, body, error, type_error, blocked):
    df = spark.createDataFrame([(1, "u", status, kind, body)], "page_id long, url string, http_status int, content_type string, body string")
    row = fetch_results(df).first()
    assert (row.fetch_error, row.extraction_error, row.blocked_suspected) == (error, type_error, blocked)
    assert (row.extracted_text is not None) == (error is None and type_error is None)


ROBOTS = "User-agent: *\nDisallow: /blocked\n"


@pytest.mark.parametrize("url, body, status, allowed", [
    ("http://h.example/allowed", ROBOTS, 200, True), ("http://h.example/blocked", ROBOTS, 200, False),
    ("http://h.example/blocked/again", ROBOTS, 200, False), ("http://h.example/blocked", ROBOTS, 404, True),
    ("http://h.example/blocked", ROBOTS, 503, True), ("h.example/blocked", ROBOTS, 200, True),
    ("ftp://h.example/blocked", ROBOTS, 200, True), ("http://H.example:80/blocked", ROBOTS, 200, False),
    ("http://h.example:8080/blocked", ROBOTS, 200, True),
    ("http://h.example/a/b", "User-agent: *\nDisallow: /a\nAllow: /a/b", 200, True),
    ("http://h.example/a/b", "User-agent: *\nDisallow: /a/*\nAllow: /a/b", 200, True),
    ("http://h.example/x.pdf", "User-agent: *\nDisallow: /*.pdf$", 200, False),
    ("http://h.example/x.pdf?y", "User-agent: *\nDisallow: /*.pdf$", 200, True),
    ("http://h.example/a", "User-agent: newsevidence\nUser-agent: b\nDisallow: /a\n\nUser-agent: *\nDisallow: /", 200, False),
    ("http://h.example/z", "User-agent: NewsEvidence\nDisallow: /a\n\nUser-agent: *\nDisallow: /", 200, True),
    ("http://h.example", "User-agent: *\nDisallow: /$", 200, False),
    ("http://h.example/a+b(c)", "User-agent: *\nDisallow: /a+b(c)", 200, False),
])
def test_robots(spark, url, body, status, allowed):
    urls = spark.createDataFrame([(url,)], "url string")
    robots = spark.createDataFrame([("http://h.example:80", status, body)], "host_key string, status int, body string")
    assert [r.allowed for r in robots_filter(urls, robots).collect()] == [allowed]


def test_host_keys(spark):
    cases = {"https://A.b/x": "https://a.b:443", "http://u:p@a.b:81?x": "http://a.b:81", "mailto:a@b": None, "a.b": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r[0] for r in df.select(host_key("u")).collect()] == list(cases.values())


def test_empty_disallow_allows():
    assert agent_rules("User-agent: *\nDisallow:", "x") == []


def test_task_functions_need_no_installed_package(tmp_path):
    """Executors get the functions by value: a Python that cannot import the package runs them."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); print(len(f('<article><p>' + 'word ' * 20)))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(page_paragraphs), cwd=tmp_path,
                          capture_output=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == b"1"


def test_deep_and_wide_pages_are_read_in_one_walk():
    deep = "<body>" + "<b>" * 5_000 + "<p>" + "w" * 60
    assert page_paragraphs(deep) == ["w" * 60]
    assert page_paragraphs("<body>" + "<div>" * 5_000 + "<p>" + "w" * 60) == ["w" * 60]
    wide = "<body>" + "<div>" * 800 + "".join(f"<p>paragraph {i} with some text" for i in range(2_000))
    start = time.perf_counter()
    assert len(page_paragraphs(wide)) == 2_000
    assert time.perf_counter() - start < 2


def test_time_follows_length_whatever_the_nesting():
    import time

    from newsevidence.operators.pages import page_paragraphs

    for inner in ("<object><p>", "<div><p>x ", "<object><p>a <a>b</a> "):
        began = time.perf_counter()
        found = page_paragraphs("<body>" + inner * 8_000 + "end")
        assert found and time.perf_counter() - began < 2.5


def test_texts_equal_plain_ones():
    """Texts cut from the page's own against texts joined piece by piece."""
    import random
    import re

    from newsevidence.operators.pages import _Tree

    r = random.Random(2)
    parts = ["<p>", "</p>", "<div>", "</div>", " ", "\n", "a", "bc ", " d", "<b>", "</b>", "<br>", "&nbsp;", "<a>", "</a>", "é😀", "<object>", "</object>"]
    for _ in range(300):
        tree = _Tree("".join(r.choice(parts) for _ in range(r.randint(1, 60))))
        for n in tree.nodes:
            assert tree.text(n) == re.sub("[ \\t\\n\\f\\r\\xa0]+", " ", "".join(tree.pieces[n.lo:n.hi])).strip()


def test_a_page_that_fails_names_the_fault(spark, monkeypatch):
    import pandas as pd

    from newsevidence.operators import pages as P

    monkeypatch.setattr(P, "MAX_LINK_SHARE", None)
    found = P._paragraphs.func(pd.Series(["<p>x</p>", None, ""]))
    assert found["error"].tolist() == ["TypeError: '>' not supported between instances of 'float' and 'NoneType'", None, None]
    monkeypatch.setattr(P, "_walk_once", lambda html: F.struct(F.array().cast("array<string>").alias("paragraphs"), F.when(html == "x", "Fault").alias("error")))
    df = spark.createDataFrame([(1, "x"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.extraction_error for r in P.extract_pages(df).collect()} == {1: "Page can't be read: Fault", 2: P.LOW_QUALITY}


def test_robots_prefixes_equal_plain_matching(spark):
    """Rule tables with many lengths, stars, anchors and ties, against every rule tried on every path."""
    import random
    import re

    from newsevidence.operators.robots import _regex

    r = random.Random(7)
    piece = lambda: "".join(r.choice("ab/") for _ in range(r.randint(0, 4)))
    hosts = {}
    for h in range(12):
        rules = []
        for _ in range(r.randint(0, 14)):
            value = "/" + piece() + r.choice(["", "", "", "*", "$", "*" + piece(), "*" + piece() + "$", "**"])
            rules.append((r.random() < 0.4, value))
        hosts[f"http://h{h}.example:80"] = rules
    urls = [(f"http://h{r.randrange(13)}.example/{piece()}{piece()}{piece()}",) for _ in range(400)] + [("ftp://x/",), (None,)]
    body = lambda rules: "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {v}" for a, v in rules)
    robots = spark.createDataFrame([(k, 200, body(v)) for k, v in hosts.items()], "host_key string, status int, body string")
    got = robots_filter(spark.createDataFrame(urls, "url string"), robots).collect()

    def plain(url):
        if url is None or not url.startswith("http"):
            return True
        host, path = re.match(r"(http://[^/]+)(/.*)", url).groups()
        hits = [(len(v), a) for a, v in hosts.get(f"{host}:80", []) if re.match(_regex(v), path)]
        return max(hits)[1] if hits else True

    assert len(got) == len(urls) and all(x.allowed == plain(x.url) for x in got) and {x.allowed for x in got} == {True, False}
