"""Landed API, feed and page payloads as raw items.

Fetching isn't part of a query: payloads are landed as rows (one document each)
and read in parallel.  Every reader gives the columns of RAW.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from calendar import timegm
from collections.abc import Callable
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AUTHORITATIVE_DOMAINS, REPO_KEYWORDS
from ..functions import scalars as S
from ..functions.udfs import join_url, parse_page, strip_html, unescape
from ..operators.filters import article_links, fresh_repo, newly_announced, quantised

RAW = "title string, source string, url string, text string, author string, published_at timestamp, score long, source_created_at timestamp, metadata string"
COLUMNS = [c.split(" ")[0] for c in RAW.split(", ")]


def _raw(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    types = dict(c.split(" ") for c in RAW.split(", "))
    values = {"source": F.lit(source), **columns}
    keep = [c for c in df.columns if c == "ord"]
    return df.select(*keep, *[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS])


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key in fetch order."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _cap(df: DataFrame, cap: int, *order: Column) -> DataFrame:
    """T9."""
    return df.orderBy(*order, "ord").limit(cap) if cap else df


def _explode(payloads: DataFrame, schema: str, path: str) -> DataFrame:
    """Rows of a JSON array inside payloads (payload string, ord long)."""
    parsed = payloads.select("ord", F.from_json("payload", schema).alias("d"))
    return parsed.select(F.col("ord").alias("page"), F.posexplode(F.col(f"d.{path}" if path else "d")).alias("pos", "r")).select(
        (F.col("page") * 100_000 + F.col("pos")).alias("ord"), "r.*"
    )


HITS = "hits array<struct<objectID: string, title: string, url: string, author: string, points: long, num_comments: long, created_at_i: long, story_text: string>>"


def hackernews(payloads: DataFrame, min_points: int = 10, since: int = 0, cap: int = 50) -> DataFrame:
    """Search hits; strict bounds; first of each story; by score."""
    hits = _explode(payloads, HITS, "hits")
    kept = _first(hits.where((F.col("created_at_i") > since) & (F.col("points") > min_points)), "objectID")
    home = F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")
    out = _raw(
        kept, "hackernews", title=unescape("title"), url=F.coalesce(F.when(F.col("url") != "", F.col("url")), home), text=F.col("story_text"),
        author=F.col("author"), published_at=F.timestamp_seconds("created_at_i"), score=F.col("points"),
        metadata=F.to_json(F.struct("num_comments", F.col("objectID").alias("story_id"), home.alias("hn_url"))),
    )
    return _cap(out, cap, F.coalesce("score", F.lit(0)).desc())


def hackernews_leading(payloads: DataFrame, domains: tuple[str, ...] = AUTHORITATIVE_DOMAINS, since: int = 0, cap: int = 50) -> DataFrame:
    """Hits of authoritative hosts, whatever their points."""
    hits = _explode(payloads, HITS, "hits").where((F.col("created_at_i") > since) & S.host_in(S.host("url"), domains))
    out = _raw(
        _first(hits, "objectID"), "hackernews", title=unescape("title"), url=F.col("url"), text=F.col("story_text"), author=F.col("author"),
        published_at=F.timestamp_seconds("created_at_i"), score=F.coalesce("points", F.lit(0)),
        metadata=F.to_json(F.struct(F.lit("leading").alias("lane"), S.host("url").alias("domain"), F.col("objectID").alias("story_id"), "num_comments")),
    )
    return _cap(out, cap)


def _entries(xml: str | None) -> list[dict]:
    """Entries of an RSS or Atom document; damaged documents have none."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        e: dict = {"title": "", "link": None, "summary": None, "authors": [], "published": None, "tags": [], "publisher": None}
        for child in node:
            name, text = child.tag.rpartition("}")[2], (child.text or "").strip()
            if name == "title":
                e["title"] = text
            elif name == "link":
                e["link"] = e["link"] or child.get("href") or text or None
            elif name in ("description", "summary", "content"):
                e["summary"] = e["summary"] or text or None
            elif name in ("author", "creator"):
                who = next((c.text for c in child if c.tag.rpartition("}")[2] == "name"), None) or text
                e["authors"] += [who.strip()] if who and who.strip() else []
            elif name in ("pubDate", "published", "updated", "date") and e["published"] is None and text:
                try:
                    when = parsedate_to_datetime(text) if name == "pubDate" else pd.Timestamp(text)
                    when = pd.Timestamp(when)
                    e["published"] = when.tz_localize("UTC") if when.tzinfo is None else when.tz_convert("UTC")
                except (ValueError, TypeError):
                    pass
            elif name == "category":
                e["tags"].append(child.get("term") or text)
            elif name == "source":
                e["publisher"] = text or None
        out.append(e)
    return out


ENTRIES = "array<struct<title: string, link: string, summary: string, authors: array<string>, published: long, tags: array<string>, publisher: string>>"


def _micros(when: pd.Timestamp | None) -> int | None:
    return None if when is None or pd.isna(when) else timegm(when.utctimetuple()) * 1_000_000 + when.microsecond


def entry_rows(xml: str | None) -> list[tuple]:
    """_entries() in the order of ENTRIES, times in microseconds."""
    return [(e["title"], e["link"], e["summary"], e["authors"], _micros(e["published"]), e["tags"], e["publisher"]) for e in _entries(xml)]


def feed_entries(payloads: DataFrame) -> DataFrame:
    """Entries (ord, title, link, summary, authors, published, tags, publisher) of landed feeds.

    A plain function gets few documents at a time; an Arrow batch holds thousands of whole ones.
    """
    read_entries = F.udf(entry_rows, ENTRIES, useArrow=False)
    found = payloads.select(F.col("ord").cast("long").alias("page"), F.posexplode(read_entries("payload")).alias("pos", "e"))
    return found.select((F.col("page") * 100_000 + F.col("pos")).alias("ord"), "e.*").withColumn("published", F.timestamp_micros("published"))


def feed_author(authors: Column) -> Column:
    """F5."""
    return F.when(F.size(authors) > 0, F.concat_ws(", ", authors))


def arxiv(payloads: DataFrame, keywords: tuple[str, ...], cap: int = 50) -> DataFrame:
    """S3: new announcements; first of each paper, and of these the ones with a keyword."""
    e = feed_entries(payloads).withColumn("arxiv_id", S.arxiv_id("link")).where(newly_announced("summary") & F.col("arxiv_id").isNotNull())
    body = strip_html(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?i)Announce Type:.*?\n?", ""))
    e = _first(e, "arxiv_id").withColumn("body", body)
    pattern = "(?i)(" + "|".join(_quote(k) for k in keywords) + ")"
    found = e.where(F.concat_ws(" ", "title", "body").rlike(pattern))
    named = F.regexp_extract(F.coalesce("summary", F.lit("")), r"Authors?:\s*(.+?)(?:\n|<)", 1)
    author = F.coalesce(feed_author(F.col("authors")), F.when(named != "", F.trim(named)), F.lit("unknown"))
    out = _raw(
        found, "arxiv", title=F.col("title"), url=F.col("link"), text=F.col("body"), author=author, published_at=F.col("published"), score=F.lit(0),
        metadata=F.to_json(F.struct("arxiv_id", F.get("tags", F.lit(0)).alias("category"), S.pdf_url("link").alias("pdf_url"))),
    )
    return _cap(out, cap)


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


POSTS = "data struct<children: array<struct<data: struct<id: string, title: string, url: string, permalink: string, selftext: string, is_self: boolean, stickied: boolean, author: string, score: long, num_comments: long, created_utc: double, subreddit: string, upvote_ratio: double>>>>"


def reddit(payloads: DataFrame, cap: int = 50) -> DataFrame:
    """Posts that aren't stickied; self posts point to themselves."""
    rows = _explode(payloads, POSTS, "data.children").select("ord", "data.*")
    posts = _first(rows.where(~F.coalesce("stickied", F.lit(False)) & F.col("id").isNotNull() & (F.col("id") != "")), "id")
    own, self_ = F.concat(F.lit("https://www.reddit.com"), "permalink"), F.coalesce("is_self", F.lit(False))
    out = _raw(
        posts, "reddit", title=F.col("title"), url=F.when(self_, own).otherwise(F.col("url")),
        text=F.when(self_ & (F.coalesce("selftext", F.lit("")) != ""), F.col("selftext")).otherwise(F.col("title")), author=F.col("author"),
        published_at=F.timestamp_seconds("created_utc"), score=F.col("score"),
        metadata=F.to_json(F.struct("subreddit", "num_comments", "upvote_ratio", F.col("id").alias("reddit_id"), "is_self", "permalink")),
    )
    return _cap(out, cap, F.coalesce("score", F.lit(0)).desc())


def rss(payloads: DataFrame, cutoff: Column, cap: int = 50) -> DataFrame:
    """First of each link across feeds, then the cutoff (undated entries stay); newest first."""
    e = _first(feed_entries(payloads).where(F.col("link").isNotNull()), "link")
    e = e.where(F.col("published").isNull() | (F.col("published") >= cutoff))
    out = _raw(
        e, "rss", title=S.trim_publisher(strip_html("title"), F.col("publisher")), url=F.col("link"), text=strip_html("summary"),
        author=feed_author(F.col("authors")), published_at=F.col("published"), metadata=F.to_json(F.struct("tags", F.col("publisher").alias("source_name"))),
    )
    return _cap(out, cap, F.col("published_at").desc_nulls_last())


def github_trending(payloads: DataFrame, as_of: Column, marker: str = '<article class="Box-row"', cap: int = 50) -> DataFrame:
    """Rows of the trending page, with an AI keyword in name or description."""
    parts = payloads.select("ord", F.posexplode(F.split("payload", _quote(marker))).alias("pos", "row")).where("pos > 0")
    parts = parts.select((F.col("ord") * 100_000 + F.col("pos")).alias("ord"), "row")
    grab = lambda p: F.trim(F.regexp_extract("row", p, 1))
    fields = parts.select(
        "ord", grab(r'(?s)<h2[^>]*>.*?href="/([^/"]+/[^/"?]+)"').alias("full_name"), grab(r"(?s)<p[^>]*>(.*?)</p>").alias("about"),
        grab(r'itemprop="programmingLanguage">([^<]+)<').alias("language"),
        S.thousands(grab(r'(?s)href="/[^"]+/stargazers"[^>]*>.*?([\d,]+)\s*</a>')).alias("stars"),
        S.thousands(grab(r"([\d,]+)\s+stars today")).alias("today"),
    ).where("full_name <> ''").withColumn("about", strip_html("about"))
    found = _first(fields.where(F.concat_ws(" ", "full_name", "about").rlike(REPO_KEYWORDS)), "full_name")
    out = _raw(
        found, "github", title=S.compose_title(F.col("full_name"), F.col("about")), url=F.concat(F.lit("https://github.com/"), "full_name"), text=F.col("about"),
        author=F.get(F.split("full_name", "/"), F.lit(0)), published_at=as_of, score=F.coalesce("stars", F.lit(0)),
        metadata=F.to_json(F.struct("language", "stars", F.col("today").alias("stars_today"))),
    )
    return _cap(out, cap)


REPOS = "items array<struct<full_name: string, html_url: string, description: string, stargazers_count: long, language: string, created_at: string, pushed_at: string, topics: array<string>, forks_count: long, owner: struct<login: string>>>"


def github_search(payloads: DataFrame, as_of: Column, min_stars: int = 200, max_age_days: int = 180, cap: int = 50) -> DataFrame:
    """Repositories above a number of stars and not too old (an unknown age passes)."""
    rows = _explode(payloads, REPOS, "items").where(F.col("stargazers_count") > min_stars)
    created = S.parse_iso("created_at")
    kept = _first(rows, "html_url").where(fresh_repo(created, as_of, max_age_days))
    out = _raw(
        kept, "github_search", title=S.compose_title(F.col("full_name"), F.col("description")), url=F.col("html_url"), text=F.col("description"),
        author=F.col("owner.login"), published_at=S.parse_iso("pushed_at"), score=F.col("stargazers_count"), source_created_at=created,
        metadata=F.to_json(F.struct("language", "topics", F.col("forks_count").alias("forks"), F.col("stargazers_count").alias("stars"))),
    )
    return _cap(out, cap, F.coalesce("score", F.lit(0)).desc())


MODELS = "array<struct<id: string, pipeline_tag: string, library_name: string, downloads: long, likes: long, tags: array<string>, lastModified: string, author: string>>"


def huggingface_models(payloads: DataFrame, cutoff: Column, min_downloads: int = 100, cap: int = 50) -> DataFrame:
    """Models with downloads, no quantised re-uploads; a missing date passes."""
    rows = _explode(payloads, MODELS, "")
    modified = S.parse_iso("lastModified")
    kept = rows.where((F.coalesce("downloads", F.lit(0)) >= min_downloads) & ~quantised(F.col("tags"), F.col("library_name")) & (modified.isNull() | (modified >= cutoff)))
    out = _raw(
        _first(kept, "id"), "huggingface", title=F.col("id"), url=F.concat(F.lit("https://huggingface.co/"), "id"),
        text=S.model_text(F.col("id"), F.col("pipeline_tag"), F.col("library_name")), author=F.get(F.split("id", "/"), F.lit(0)), published_at=modified,
        score=F.col("downloads"), metadata=F.to_json(F.struct("pipeline_tag", "downloads", "likes", "tags", F.lit("model").alias("type"))),
    )
    return _cap(out, cap)


PAPERS = "array<struct<paper: struct<id: string, title: string, upvotes: long, publishedAt: string>>>"


def huggingface_papers(payloads: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Daily papers with their abstracts (arxiv_id, abstract), version ignored."""
    rows = _first(_explode(payloads, PAPERS, "").select("ord", "paper.*").where("id is not null and id <> ''"), "id")
    known = abstracts.select(F.get(F.split("arxiv_id", "v"), F.lit(0)).alias("id"), "abstract").dropDuplicates(["id"])
    j = rows.join(known, "id", "left")
    return _raw(
        j, "huggingface", title=F.col("title"), url=F.concat(F.lit("https://huggingface.co/papers/"), "id"),
        text=S.prepare_text("title", "abstract"), published_at=S.parse_iso("publishedAt"), score=F.col("upvotes"),
        metadata=F.to_json(F.struct(F.col("id").alias("paper_id"), "upvotes", F.lit("daily_paper").alias("type"), F.col("abstract").isNotNull().alias("has_abstract"))),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """S10, phase 1: article links (page_url, pos, href, label, canonical) of landed index pages (url, html)."""
    links = pages.select(F.col("url").alias("page_url"), F.posexplode(parse_page("html")["links"]).alias("pos", "link"))
    raw = links.select("page_url", "pos", F.col("link.href").alias("raw"), F.col("link.label").alias("label"))
    raw = raw.where(~F.col("raw").startswith("#") & ~F.lower("raw").startswith("javascript:") & ~F.lower("raw").startswith("mailto:"))
    return article_links(raw.withColumn("href", join_url("page_url", "raw")))


def web_pages(pages: DataFrame) -> DataFrame:
    """S10, phase 2: landed pages (url, html) as items; pages without text are skipped."""
    p = pages.withColumn("p", parse_page("html")).where("p.text <> ''").select("url", "p.*")
    line = F.get(F.split("text", "\n"), F.lit(0))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(line != "", F.substring(line, 1, 200)), F.lit("Untitled"))
    return _raw(
        p, "webscraper", title=title, url=F.col("url"), text=F.col("text"), score=F.lit(0),
        metadata=F.to_json(F.struct(S.host("url").alias("domain"), S.word_count("text").alias("word_count"))),
    )


def raw_to_items(raw: DataFrame) -> DataFrame:
    """raw_extractions (source, source_id, raw_json, extracted_at) as items."""
    j = lambda p: F.get_json_object("raw_json", f"$.{p}")
    hn, gh = F.col("source") == "hackernews", F.col("source").isin("github", "github_search")
    hf = F.col("source") == "huggingface"
    when = F.when(hn, F.timestamp_seconds(j("created_at_i").try_cast("long"))).when(gh, S.parse_iso(j("pushed_at"))).when(hf, S.parse_iso(j("lastModified")))
    return raw.select(
        F.when(hn, j("title")).when(gh, S.compose_title(j("full_name"), j("description"))).otherwise(j("id")).alias("title"), "source",
        F.when(hn, F.coalesce(j("url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), j("objectID"))))
        .when(gh, j("html_url")).otherwise(F.concat(F.lit("https://huggingface.co/"), j("id"))).alias("url"),
        F.when(hn, j("story_text")).when(gh, j("description")).otherwise(S.model_text(j("id"), j("pipeline_tag"), j("library_name"))).alias("text"),
        F.coalesce(when, F.col("extracted_at")).alias("published_at"),
        F.when(hn, j("points")).when(gh, j("stargazers_count")).otherwise(j("downloads")).try_cast("long").alias("score"),
    )


def month_ranges(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Months first..last as (month, start, next) with epochs."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("interval 1 month"))).alias("start"))
    following = F.add_months("start", 1)
    return months.select(
        F.date_format("start", "yyyy-MM").alias("month"), "start", following.alias("next"),
        F.unix_timestamp(F.col("start").cast("timestamp")).alias("start_epoch"), F.unix_timestamp(following.cast("timestamp")).alias("next_epoch"),
    )


#: Readers by name; an unknown name is a KeyError.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "hackernews": hackernews, "hackernews_leading": hackernews_leading, "arxiv": arxiv, "reddit": reddit, "rss": rss, "github": github_trending,
    "github_search": github_search, "huggingface": huggingface_models, "huggingface_papers": huggingface_papers, "webscraper": web_pages,
}


def union_sources(found: dict[str, DataFrame], enabled: list[str], requested: list[str] | None = None) -> DataFrame:
    """Items of the enabled and requested sources, in enabled order (source_ord)."""
    names = [n for n in enabled if n in found and (requested is None or n in requested)]
    if not names:
        raise ValueError("no source is enabled and requested")
    parts = [found[n].select(F.lit(k).alias("source_ord"), *COLUMNS) for k, n in enumerate(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
