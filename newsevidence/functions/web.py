"""Outcomes of landed page fetches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, is_blank

# Status codes, phrases and messages that results depend on.
BLOCKED_STATUS = [403, 429, 503]
CAPTCHA = r"(?i)(captcha|verify you are human|attention required|cloudflare|bot detection)"
BLOCKED_MESSAGE = "Blocked/Rate-limited/CAPTCHA suspected"
HTML_TYPES = ["text/html", "application/xhtml+xml"]
MEDIA_MARKERS = [
    "/video/", "/videos/", "/newsfeed/", "/latest-news-bulletin", "/picture/", "/cartoon/",
    "/gallery/", "/slideshow/", "/watch/", "/live/", "/iplayer/",
]
REASON_ROBOTS = "ROBOTS_DISALLOWED"
REASON_BLOCKED = "BLOCKED_OR_CAPTCHA"
REASON_EXTRACTION = "EXTRACTION_FAILED"


def _is_2xx(status: Column) -> Column:
    return status.between(200, 299)


def blocked_suspected(status, body) -> Column:
    """Non-2xx answers that look like a block; the phrase is looked for in the first 2000 characters, as the rule says."""
    status = col(status)
    head = F.regexp_replace(F.substring(col(body), 1, 2000), r"\s+", " ")
    phrase = F.coalesce(head.rlike(CAPTCHA), F.lit(False))
    return F.coalesce(~_is_2xx(status) & (status.isin(BLOCKED_STATUS) | phrase), F.lit(False))


def fetch_error(status, body) -> Column:
    status = col(status)
    return F.when(blocked_suspected(status, body), F.lit(BLOCKED_MESSAGE)).when(
        ~_is_2xx(status), F.concat(F.lit("HTTP status "), status.cast("string"))
    )


def content_type_error(status, content_type) -> Column:
    """Message for a 2xx answer that is not HTML."""
    kind = F.lower(col(content_type))
    html = F.lit(False)
    for name in HTML_TYPES:
        html = html | F.contains(kind, F.lit(name))
    message = F.concat(F.lit("Non-HTML contentType: "), F.coalesce(col(content_type), F.lit("null")))
    return F.when(_is_2xx(col(status)) & ~F.coalesce(html, F.lit(False)), message)


def is_media_url(url) -> Column:
    pattern = "|".join(m.replace("-", r"\-") for m in MEDIA_MARKERS)
    return F.coalesce(F.lower(col(url)).rlike(pattern), F.lit(False))


def skips_media(url, raw_text) -> Column:
    """Media pages are skipped unless the item brings its own text."""
    return is_blank(raw_text) & is_media_url(url)


def block_reason(blocked, fetch_error_col, extraction_error_col) -> Column:
    """Why an endpoint may be blocked, by the first rule that fits; null when none does."""
    has = lambda c, token: F.contains(F.lower(col(c)), F.lit(token))
    return (
        F.when(col(blocked), F.lit(REASON_BLOCKED))
        .when(has(fetch_error_col, "robots.txt"), F.lit(REASON_ROBOTS))
        .when(has(extraction_error_col, "low-quality extraction"), F.lit(REASON_EXTRACTION))
    )
