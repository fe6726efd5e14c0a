"""Date ranges, optional filters, search predicates and validity checks."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NON_CONTENT_SEGMENTS
from ..functions.scalars import col, host


def effective_date() -> Column:
    return F.coalesce("published_at", "created_at")


def on_day(ts: Column | str, day: Column | str) -> Column:
    """ts in [day, day + 1)."""
    d = F.lit(day).cast("date") if isinstance(day, str) else day
    return (col(ts) >= d.cast("timestamp_ntz")) & (col(ts) < F.date_add(d, 1).cast("timestamp_ntz"))


def between_days(ts: Column | str, first: str | None, last: str | None) -> Column:
    """Days first..last, both included; a missing bound is open."""
    keep = F.lit(True)
    if first:
        keep = keep & (col(ts) >= F.lit(first).cast("date").cast("timestamp_ntz"))
    if last:
        keep = keep & (col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return keep


def since_days(as_of: Column, days: int) -> Column:
    """Midnight of the day ``days`` before."""
    return F.date_sub(as_of.cast("date"), days).cast("timestamp_ntz")


def since_hours(as_of: Column, hours: int) -> Column:
    return (as_of - F.make_dt_interval(hours=F.lit(hours))).cast("timestamp_ntz")


def check_range(first: str | None, last: str | None) -> tuple[str, str] | None:
    """Both bounds in order, or none; anything else is an error."""
    if first is None and last is None:
        return None
    if first is None or last is None:
        raise ValueError("give both date_from and date_to, or neither")
    if date.fromisoformat(first) > date.fromisoformat(last):
        raise ValueError("date_from is after date_to")
    return first, last


def where_given(df: DataFrame, trending: bool | None = None, **equal: str | None) -> DataFrame:
    """Equality filters for the arguments that are given (an empty string isn't)."""
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    return df if trending is None else df.where(F.col("trending") == trending)


def text_tokens(*columns: str) -> Column:
    """Words of 'simple' full-text search: lower case, no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"[\p{L}\p{N}_]+"), 0)


def matches_all(words: Column, query: str) -> Column:
    """All words of the query occur; an empty query matches nothing."""
    wanted = query_words(query)
    return F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(words, w)) if wanted else F.lit(False)


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def contains_any(query: str, *columns: str) -> Column:
    """Case-insensitive contains in any column; % and _ in the query are wildcards."""
    keep = F.lit(False)
    for c in columns:
        keep = keep | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return keep


def errors() -> Column:
    """What is wrong with a raw row: missing title, missing url."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return F.array_compact(F.array(
        F.when(blank("title"), "missing or empty title"), F.when(blank("url"), "missing or empty url")
    ))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size(errors()) == 0)


def accepted(min_relevance: float, topics: tuple[str, ...]) -> Column:
    return F.col("topic").isin(*topics) & (F.col("relevance") >= min_relevance)


def credible(min_credibility: float) -> Column:
    return F.coalesce(F.col("credibility_score"), F.lit(0.0)) >= min_credibility


def engaged(min_score: int) -> Column:
    """Rows from social sources need a score, except those of the leading lane."""
    social = F.lower("source").isin("hackernews", "reddit")
    leading = F.coalesce(F.get_json_object("metadata", "$.lane") == "leading", F.lit(False))
    return ~social | leading | (F.coalesce("score", F.lit(0)) >= min_score)


def quantised(tags: Column, library: Column) -> Column:
    tagged = F.coalesce(F.exists(tags, lambda t: t.startswith("base_model:quantized:")), F.lit(False))
    return tagged | library.isNull()


def newly_announced(text: Column | str) -> Column:
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return low.contains("announce type: new") | ~low.contains("announce type:")


def fresh_repo(created: Column, as_of: Column, max_days: int) -> Column:
    """Whole days since creation within the limit; null passes; a limit of 0 or less is none."""
    if max_days <= 0:
        return F.lit(True)
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1e6 / 86400)
    return F.coalesce(age <= max_days, F.lit(True))


def article_links(links: DataFrame) -> DataFrame:
    """links (page_url, pos, href): article links of the page's own host, one for each canonical url.

    At least two path segments, none of them a non-content one, not the index page itself.
    """
    path = F.coalesce(F.try_parse_url("href", F.lit("PATH")), F.lit(""))
    own_path = F.rtrim(F.coalesce(F.try_parse_url("page_url", F.lit("PATH")), F.lit("")), F.lit("/"))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    low = F.transform(segments, F.lower)
    canonical = F.concat(F.lower(F.try_parse_url("href", F.lit("PROTOCOL"))), F.lit("://"), host("href"), F.rtrim(path, F.lit("/")))
    kept = links.where(
        (host("href") == host("page_url")) & (F.size(segments) >= 2) & (F.rtrim(path, F.lit("/")) != own_path)
        & ~F.arrays_overlap(low, F.array(*map(F.lit, NON_CONTENT_SEGMENTS)))
    ).withColumn("canonical", canonical)
    first = Window.partitionBy("page_url", "canonical").orderBy("pos")
    return kept.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")

