"""Pure column builders: hashes, keyword classes, velocity, composite, credibility,
tokens and similarity.  All take and give columns; times are explicit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, PARAMETER_SIZE, PROFESSIONAL_PATTERNS, QUANTISED_SUFFIX, SOURCE_CREDIBILITY, SUSPICIOUS_PATTERNS, TOPIC_WEIGHTS, VELOCITY_THRESHOLDS, Settings


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    """Value of a short constant map, or the default."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(default))


# Hashes and text

def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def content_hash(title="title", url="url") -> Column:
    return hash16(F.concat(col(title), F.lit("|"), F.coalesce(col(url), F.lit(""))))


def url_hash(url="url") -> Column:
    """Null for a null or empty url; the url isn't normalised."""
    return F.when(col(url) != "", hash16(col(url)))


def strip_tags(text: Column | str) -> Column:
    """Tags removed, runs of (Unicode) white space made one blank, trimmed; entities stay (see udfs.strip_html)."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), "<[^>]+>", ""), r"(?U)\s+", " "))


def terminated_only(html: Column | str) -> Column:
    """HTML in which an ampersand that begins no character reference with its semicolon stands for itself.

    HTML also decodes some names that text was cut off behind ("R&amp"); SQL counterparts leave them.
    """
    return F.regexp_replace(col(html), r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def prepare_text(title="title", summary="summary") -> Column:
    return F.concat_ws("\n", col(title), F.when(col(summary) != "", col(summary)))


def host(url="url") -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def host_in(h: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or under one."""
    known = F.array(*[F.lit(d) for d in domains])
    return F.coalesce(F.exists(known, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))), F.lit(False))


def word_count(text: Column | str) -> Column:
    trimmed = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def thousands(text: Column | str) -> Column:
    return F.replace(col(text), F.lit(","), F.lit("")).try_cast("int")


def arxiv_id(link: Column | str) -> Column:
    found = F.regexp_extract(col(link), r"arxiv\.org/abs/([^\s?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"v\d+$", ""))


def pdf_url(link: Column | str) -> Column:
    return F.when(col(link).contains("/abs/"), F.replace(col(link), F.lit("/abs/"), F.lit("/pdf/"))).otherwise("")


def trim_publisher(title: Column, publisher: Column) -> Column:
    tail = F.concat(F.lit(" - "), publisher)
    return F.when(
        (F.coalesce(publisher, F.lit("")) != "") & title.endswith(tail), title.substr(F.lit(1), F.length(title) - F.length(tail))
    ).otherwise(title)


def compose_title(name: Column, description: Column) -> Column:
    return F.concat_ws(": ", name, F.when(description != "", description))


def model_text(model_id: Column, task: Column, library: Column) -> Column:
    return F.concat_ws(" | ", model_id, F.when(task != "", F.concat(F.lit("Task: "), task)), F.when(library != "", F.concat(F.lit("Library: "), library)))


def model_name(title="title") -> Column:
    """Base model of "org/model": quantisation suffix and sizes removed, lower case; null without a slash."""
    parts = F.split(col(title), "/", 2)
    name = F.regexp_replace(F.regexp_replace(F.get(parts, 1), QUANTISED_SUFFIX, ""), PARAMETER_SIZE, "")
    return F.when(col(title).contains("/"), F.lower(name))


def parse_iso(text: Column | str) -> Column:
    return F.try_to_timestamp(F.when(col(text) != "", col(text)))


# Keyword classes

def bounded(word: str) -> str:
    """A pattern for a word between non-word characters, alike in Java and RE2."""
    escaped = "".join("\\" + c if not (c.isalnum() or c in " _") else c for c in word.lower())
    return rf"(^|[^\p{{L}}\p{{N}}_]){escaped}($|[^\p{{L}}\p{{N}}_])"


def keyword_counts(text: Column, words: Column, keywords: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Number of each topic's keywords that occur in lower-case text, each counted once.

    words: the distinct words of the text.  A keyword that is one word is looked up
    among them; others (with blanks or hyphens) need a pattern, after a plain search.
    """

    def count(topic: Sequence[str]) -> Column:
        low = list(dict.fromkeys(w.lower() for w in topic))
        plain = [w for w in low if w.replace("_", "").isalnum()]
        found = [F.size(F.array_intersect(words, F.array(*map(F.lit, plain))))] if plain else [F.lit(0)]
        found += [F.when(text.contains(w) & text.rlike(bounded(w)), 1).otherwise(0) for w in low if w not in plain]
        return reduce(lambda a, b: a + b, found)

    return {t: count(topic) for t, topic in keywords.items()}


def keyword_text(title="title", text="full_text") -> Column:
    return F.lower(F.concat(col(title), F.lit(" "), F.substring(F.coalesce(col(text), F.lit("")), 1, 500)))


def best_topic(counts: Mapping[str, Column], keywords: Mapping[str, Sequence[str]]) -> Column:
    """struct(matches, place, topic, size) of the topic with most keywords (first on ties)."""
    return F.array_max(F.array(*[
        F.struct(c.alias("matches"), F.lit(-k).alias("place"), F.lit(t).alias("topic"), F.lit(len(keywords[t])).alias("size"))
        for k, (t, c) in enumerate(counts.items())
    ]))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once a row however often ``then`` names it.  Spark moves filters below
    projections and then writes a column's expression out wherever the filter names it; a lambda's variable stays one."""
    return F.get(F.transform(F.array(value), then), 0)


def keyword_class(title: Column | str, text: Column | str, keywords: Mapping[str, Sequence[str]]) -> Column:
    """struct(topic, relevance, matches), as one expression that reads its text, words and best topic once."""

    def classed(best: Column) -> Column:
        relevance = F.least(best["matches"] / best["size"] * 3, F.lit(1.0))
        real = (best["matches"] > 0) & (relevance >= 0.1)
        return F.struct(
            F.when(real, best["topic"]).alias("topic"), F.when(real, relevance).otherwise(0.0).alias("relevance"),
            F.when(real, best["matches"]).otherwise(0).alias("matches"),
        )

    def of_words(low: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), 0))
        return once(words, lambda found: once(best_topic(keyword_counts(low, found, keywords), keywords), classed))

    return once(keyword_text(title, text), of_words)


def with_keyword_class(df: DataFrame, title: str = "title", text: str = "full_text", keywords: Mapping[str, Sequence[str]] = DEFAULT.keywords) -> DataFrame:
    """Adds topic, relevance and matches."""
    found = df.withColumn("_class", keyword_class(title, text, keywords))
    return found.withColumns({c: F.col(f"_class.{c}") for c in ("topic", "matches", "relevance")}).drop("_class")


def gate(matches: Column) -> Column:
    """accept (three keywords or more), ambiguous (one or two), reject."""
    return F.when(matches >= 3, "accept").when(matches >= 1, "ambiguous").otherwise("reject")


def priority(score="score", relevance="relevance_score", source="source") -> Column:
    s, r = F.coalesce(col(score), F.lit(0)), col(relevance)
    base = F.when(s > 500, 1).when(s > 200, 2).when(s > 50, 3).when(s > 10, 4).otherwise(5)
    shift = F.when(r >= 0.95, -2).when(r >= 0.9, -1).when(r <= 0.75, 1).otherwise(0)
    calm = F.when(col(source).isin("rss", "arxiv"), -1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), base + shift + calm))


# Ranking scores

def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def velocity(as_of: Column, source="source", score="score", published="published_at", created: Column | None = None, kind: Column | None = None) -> Column:
    """Engagement a unit of time: stars a day, points an hour; null where a source has none."""
    s, src, pub = col(score), col(source), col(published)
    born = F.coalesce(created, pub) if created is not None else pub
    days = F.greatest(F.lit(1 / 24), seconds_between(as_of, born) / 86400)
    hours = F.greatest(F.lit(1.0), seconds_between(as_of, pub) / 3600)
    paper = F.coalesce(kind == "daily_paper", F.lit(False)) if kind is not None else F.lit(False)
    hourly = F.when(pub.isNull(), 0.0).otherwise(s / hours)
    return (
        F.when(src.isin("arxiv", "rss"), F.lit(None).cast("double"))
        .when(s.isNull() | (s <= 0), 0.0)
        .when(src.isin("github", "github_search"), F.when(born.isNull(), 0.0).otherwise(s / days))
        .when((src == "huggingface") & ~paper, s.cast("double"))
        .otherwise(hourly)
    )


def velocity_norm(v: Column, source="source", kind: Column | None = None) -> Column:
    key = col(source)
    if kind is not None:
        key = F.when((key == "huggingface") & (kind == "daily_paper"), "huggingface_paper").otherwise(key)
    return F.least(F.lit(1.0), v / lookup(key, VELOCITY_THRESHOLDS, 500.0))


def relevance_norm(relevance="relevance_score") -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(col(relevance), F.lit(0.0)) - 0.75) / 0.25))


def recency(as_of: Column, published="published_at", hours: float = DEFAULT.recency_hours) -> Column:
    """Linear decay over ``hours``; null gives 0; a future time exceeds 1."""
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - seconds_between(as_of, col(published)) / 3600 / hours), F.lit(0.0))


def topic_weight(topic="topic") -> Column:
    return lookup(col(topic), TOPIC_WEIGHTS, 0.5)


def composite(as_of: Column, settings: Settings = DEFAULT, kind: Column | None = None, created: Column | None = None) -> Column:
    """Ranking score of a row with source, score, published_at, relevance_score, topic."""
    v = velocity(as_of, created=created, kind=kind)
    r, t, w = relevance_norm(), recency(as_of, hours=settings.recency_hours), topic_weight()
    a, b = settings.velocity_weights, settings.plain_weights
    return F.when(v.isNull(), b[0] * r + b[1] * t + b[2] * w).otherwise(a[0] * velocity_norm(v, kind=kind) + a[1] * r + a[2] * t + a[3] * w)


# Credibility

def engagement(score="score") -> Column:
    s = F.coalesce(col(score), F.lit(0))
    return F.when(s >= 500, 1.0).when(s >= 200, 0.7).when(s >= 50, 0.5).when(s >= 10, 0.3).otherwise(0.1)


def tone(title="title", text="full_text") -> Column:
    content = F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.substring(F.coalesce(col(text), F.lit("")), 1, 500))
    parts = [F.when(content.rlike(p), -0.1).otherwise(0.0) for p in SUSPICIOUS_PATTERNS]
    parts += [F.when(content.rlike(p), 0.05).otherwise(0.0) for p in PROFESSIONAL_PATTERNS]
    return reduce(lambda a, b: a + b, parts)


def credibility(settings: Settings = DEFAULT, source="source", url="url") -> Column:
    trusted = F.when(host_in(host(url), settings.trusted), 0.3).otherwise(0.0)
    total = lookup(F.lower(col(source)), SOURCE_CREDIBILITY, 0.05) + trusted + engagement() * 0.2 + tone()
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


# Tokens and similarity

def tokens(text: Column | str, stopwords: Sequence[str] = ()) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("[a-zA-Z0-9]+"), 0))
    return F.array_except(words, F.array(*map(F.lit, stopwords))) if stopwords else words


def item_tokens(stopwords: Sequence[str], title="title", text="full_text") -> Column:
    return tokens(F.concat(col(title), F.lit(" "), F.substring(F.coalesce(col(text), F.lit("")), 1, 200)), stopwords)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def freshness(hours: Column) -> Column:
    return F.when(hours.isNull(), "dead").when(hours <= 2, "ok").when(hours <= 24, "stale").otherwise("dead")
