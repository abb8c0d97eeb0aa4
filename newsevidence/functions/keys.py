"""Keys: URL hash, site domain, chunk id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

# Punctuation that may wrap a pasted address.
_WRAP = r"""[\x00-\x20"'()\[\]{},;]"""
# Characters a strict URI parse refuses anywhere.
_ILLEGAL = r"""[\s"<>\\^`{|}\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})"""
# Host of a URL or of a bare address: nothing illegal, a scheme or no scheme at all, user-info and
# port left out, no label over 63 characters.
_HOST = (
    rf"^(?!.*(?:{_ILLEGAL}))"
    r"(?:[A-Za-z][A-Za-z0-9+.\-]*://|(?!.*://))"
    r"(?:[^/?#]*@)?"
    r"(?![^/?#]*[^./?#:]{64})"
    r"([^/?#@]*?)(?::[^:\]/?#]*)?(?:[/?#].*)?$"
)


def sha256_hex(c) -> Column:
    return F.sha2(col(c), 256)


@F.pandas_udf(T.StringType())
def _punycode(hosts: pd.Series) -> pd.Series:
    def encode(host: str):
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(encode, na_action="ignore")


def normalize_domain(c) -> Column:
    """Site key: host, lower case, punycode, one leading ``www.`` dropped; null if invalid.

    Only non-ASCII hosts are handed to Python.
    """
    text = F.regexp_replace(col(c), f"^{_WRAP}+|{_WRAP}+$", "")
    host = F.lower(F.regexp_extract(text, _HOST, 1))
    foreign = host.rlike(r"[^\x00-\x7F]")
    key = F.when(foreign, _punycode(F.when(foreign, host))).otherwise(host)
    return F.nullif(F.regexp_replace(key, r"^www\.", ""), F.lit(""))


def rated_domain(c) -> Column:
    """Domain of a rated outlet; it must hold a dot."""
    domain = normalize_domain(c)
    return F.when(F.contains(domain, F.lit(".")), domain)


def chunk_object_id(article_id, index) -> Column:
    """Name-based UUID (version 3, no namespace) of ``a:{article}:c:{index}``."""
    name = F.concat(F.lit("a:"), col(article_id).cast("string"), F.lit(":c:"), col(index).cast("string"))
    digest = F.md5(name)
    # Variant bits: the two high bits of this digit become binary 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
