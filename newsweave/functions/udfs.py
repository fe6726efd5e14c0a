"""Arrow UDFs for what has no built-in: edit-style title similarity, HTML, URLs, IPs."""

from __future__ import annotations

import html
import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import main_content

TAGS, BLANKS = re.compile(r"<[^>]+>"), re.compile(r"\s+")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits a row (Hyyro's update)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        hit = v & where.get(ch, 0)
        v = (v + hit | v - hit) & full
    return len(a) - v.bit_count()


def similarity(a: str | None, b: str | None, ratio: float = 0.6) -> float:
    """2 LCS / (len a + len b) of lower-cased titles; 0 if one is empty or much shorter."""
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < ratio:
        return 0.0
    x, y = a.lower(), b.lower()
    return 1.0 if x == y else 2.0 * common_length(x, y) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def strip_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else BLANKS.sub(" ", html.unescape(TAGS.sub("", t))).strip())


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or l is None else urljoin(b, l) for b, l in zip(base, link)], dtype="object")


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(_LINK))])


@F.pandas_udf(PAGE)
def parse_page(pages: pd.Series) -> pd.DataFrame:
    """Title, main content and links of HTML."""
    rows = []
    for page in pages:
        p = main_content.Page(page or "")
        rows.append((" ".join(p.title.split()), "\n".join(main_content.lines(p.content())), [{"href": h, "label": t} for h, t in p.links]))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


def is_public(address: str | None) -> bool:
    """False for IP literals that are private, loopback, link-local, reserved or no address."""
    try:
        ip = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return False
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


@F.pandas_udf(T.BooleanType())
def public_address(host: pd.Series) -> pd.Series:
    """is_public() of each row."""
    return host.map(is_public)


@F.pandas_udf(T.BooleanType())
def safe_url(url: pd.Series) -> pd.Series:
    """http(s) and no private IP literal; names are not resolved here (providers.safe_get does)."""

    def check(u):
        try:
            parts = urlsplit(u or "")
            host = parts.hostname or ""
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not host or host == "localhost":
            return False
        try:
            ipaddress.ip_address(host)
        except ValueError:
            return True
        return is_public(host)

    return url.map(check)
