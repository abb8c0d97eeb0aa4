"""Robots rules as rows, and their application to whole URL tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .keyed import salted_join

RULE = "host_key string, allow boolean, prefix string, pattern string, length int"
_URL = r"^(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d+))?([^#]*)"


def host_key(url) -> Column:
    """``scheme://host:port`` with the effective port; null for anything but http and https."""
    url = col(url)
    scheme = F.regexp_extract(url, _URL, 1)
    port = F.regexp_extract(url, _URL, 3)
    default = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    key = F.concat(
        scheme, F.lit("://"), F.lower(F.regexp_extract(url, _URL, 2)), F.lit(":"),
        F.when(port == "", default).otherwise(port),
    )
    return F.when(scheme != "", key)


def request_path(url) -> Column:
    """Path and query of a URL, at least ``/``."""
    path = F.regexp_extract(col(url), _URL, 4)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def _regex(pattern: str) -> str:
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    return "^" + ".*".join(re.escape(piece) for piece in body.split("*")) + ("$" if anchored else "")


def _prefix(pattern: str) -> str | None:
    """The prefix that a pattern stands for; None for one with a wildcard inside or an anchor."""
    body = pattern.rstrip("*")
    return None if "*" in body or pattern.endswith("$") else body


def agent_rules(body: str, agent: str) -> list[tuple[bool, str, int]]:
    """Rules of the group that names ``agent``, else of ``*``, as (allow, pattern, pattern length)."""
    groups: dict[str, list[tuple[bool, str, int]]] = {}
    names: list[str] = []
    open_head = False
    for line in body.splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [*names, value.lower()] if open_head else [value.lower()]
            open_head = True
            for name in names:
                groups.setdefault(name, [])
        elif field in ("allow", "disallow"):
            open_head = False
            if value:
                for name in names:
                    groups[name].append((field == "allow", value, len(value)))
    return groups.get(agent.lower(), groups.get("*", []))


def robots_rules(robots: DataFrame, agent: str = "newsevidence") -> DataFrame:
    """A row per rule, ``host_key, allow, prefix, pattern, length``, from ``robots(host_key, status, body)``.

    Each body is parsed once. A plain rule has a ``prefix``, any other one a ``pattern`` (a regular expression). Only 2xx
    answers restrict anything. Of several answers of a host the first body in text order counts.
    """
    usable = robots.filter(F.col("status").between(200, 299) & F.col("body").isNotNull())
    usable = usable.groupBy("host_key").agg(F.min("body").alias("body"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host_key", "allow", "prefix", "pattern", "length"]
        for batch in batches:
            rows = []
            for host, body in zip(batch["host_key"], batch["body"]):
                for allow, value, length in agent_rules(body, agent):
                    prefix = _prefix(value)
                    rows.append((host, allow, prefix, None if prefix is not None else _regex(value), length))
            yield pd.DataFrame(rows, columns=names)

    return usable.select("host_key", "body").mapInPandas(parse, RULE)


def robots_filter(urls: DataFrame, robots: DataFrame, url: str = "url", agent: str = "newsevidence") -> DataFrame:
    """Adds ``allowed``. The longest matching pattern decides, allow wins a tie, no match allows.

    Each distinct path of a host is cut to the lengths that the host's plain rules have, and those prefixes meet the rule
    table by an equi-join; only rules with wildcards or anchors are matched one by one. What a host has of lengths and
    patterns is one row, joined to its paths with salted keys, so a host with very many URLs is many tasks.
    """
    rules = robots_rules(robots, agent)
    weight = F.struct("length", "allow")
    plain = rules.filter("prefix is not null").groupBy("host_key", "prefix").agg(F.max(weight).alias("w"))
    lengths = plain.groupBy("host_key").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    patterns = rules.filter("pattern is not null").groupBy("host_key").agg(
        F.collect_set(F.struct("pattern", "length", "allow")).alias("patterns"))
    keyed = urls.withColumn("host_key", host_key(url)).withColumn("_path", request_path(url))
    paths = keyed.filter("host_key is not null").select("host_key", "_path").distinct()
    cut = salted_join(paths, lengths, ["host_key"], ["_path"], "inner").withColumn(
        "n", F.explode(F.filter("lengths", lambda n: n <= F.length("_path"))))
    met = cut.select("host_key", "_path", F.substring(F.col("_path"), F.lit(1), F.col("n")).alias("prefix")).join(plain, ["host_key", "prefix"])
    odd = salted_join(paths, patterns, ["host_key"], ["_path"], "inner").withColumn(
        "r", F.explode(F.filter("patterns", lambda r: F.regexp_like(F.col("_path"), r["pattern"]))))
    hits = met.select("host_key", "_path", "w").unionByName(odd.select("host_key", "_path", F.struct("r.length", "r.allow").alias("w")))
    verdict = hits.groupBy("host_key", "_path").agg(F.max("w")["allow"].alias("allowed"))
    out = keyed.join(verdict, ["host_key", "_path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], F.coalesce("allowed", F.lit(True)).alias("allowed"))
