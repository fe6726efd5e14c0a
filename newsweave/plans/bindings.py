"""The driver's tables as items, embeddings, briefings and runs; for tests and queries.

ITEMS_SQL is the same view for the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
SOURCE_BY_ID = ("hackernews", "arxiv", "reddit", "rss", "github", "github_search", "huggingface", "webscraper")
TOPIC_BY_ID = ("models", "papers", "agents", "products", "tools", "open_source", "regulation")
#: Frequent words of the invented languages, so that the keyword classifier meets all its gates.
SURROGATE_KEYWORDS = {
    "models": ("the", "of", "and", "to"), "tools": ("in", "that", "is", "for"), "papers": ("le", "la", "les", "et"),
    "products": ("der", "die", "und", "das"), "open_source": ("license", "mit", "apache", "copyright"),
    "agents": ("el", "los", "que", "de"), "regulation": ("on", "with", "as", "by"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(timestamp: str = AS_OF):
    return F.lit(timestamp).cast("timestamp_ntz")


def _title() -> Column:
    return F.translate(F.substring("text", 1, 80), "\n", " ").alias("title")


def _source() -> Column:
    return F.element_at(F.array(*map(F.lit, SOURCE_BY_ID)), (F.col("doc_id") % 8 + 1).cast("int")).alias("source")


def _summary() -> Column:
    return F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 120)).alias("summary")


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search looks at in items: id, title, summary, full_text and source of each.  All of it stands in documents, so
    no text moves through the joins that give items their urls and dates."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _title(), _summary(), F.col("text").alias("full_text"), _source())


def items(spark: SparkSession, sf_dir: str, reads: int | None = None) -> DataFrame:
    """news_items: one row per document, ``ord`` being its place in the input.

    ``reads``: the characters of full_text that a query's operators look at by their definition (500 for keywords and tone,
    200 for tokens); the rest of the text then doesn't move through the joins.
    """
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_id"), F.col("url").alias("p_url"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("e_id"), F.col("ts").alias("e_ts"))
    n_pages, n_events = max(pages.count(), 1), max(events.count(), 1)  # parquet footers only
    id_ = F.col("doc_id")
    base = docs.select(
        id_.alias("id"), id_.alias("ord"), F.substring("text", 1, reads).alias("text") if reads else F.col("text"), "n_chars",
        _title(),
        _summary(),
        _source(),
        F.when(id_ % 13 != 0, F.element_at(F.array(*map(F.lit, TOPIC_BY_ID)), (id_ % 7 + 1).cast("int"))).alias("topic"),
        F.round(F.lit(0.70) + (id_ % 31) / 100, 2).alias("relevance_score"),
        F.when(id_ % 10 != 0, (7 * F.col("n_chars") + id_) % 700).alias("score"),
        (id_ % 9 == 0).alias("trending"),
        (at("2024-01-15 00:00:00").cast("timestamp") + F.make_dt_interval(secs=((7919 * id_) % 1382400).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit("author"), id_ % 17).alias("author"),
        (id_ % n_pages).alias("p_key"), ((10 * id_) % n_events).alias("e_key"),
    )
    joined = base.join(pages, F.col("p_key") == F.col("p_id"), "left").join(events, F.col("e_key") == F.col("e_id"), "left")
    published = F.when(F.col("id") % 7 != 0, F.col("e_ts"))
    return joined.select(
        "id", "ord", "title", "summary", F.when(F.col("id") % 11 != 0, F.col("p_url")).alias("url"), "source", "topic",
        "relevance_score", "score", "trending", published.alias("published_at"), "created_at",
        F.coalesce(published, F.col("created_at")).alias("ed"), "author", F.col("text").alias("full_text"),
        F.when(F.col("id") % 16 == 0, F.lit('{"lane":"leading"}')).otherwise(F.lit("{}")).alias("metadata"),
        F.when(F.col("id") % 4 != 1, F.round((F.col("id") * 37 % 101) / 100, 2)).alias("composite_score"),
        (F.col("id") % 5 + 1).cast("int").alias("priority"),
    )


ITEMS_SQL = """
items AS (
  SELECT d.doc_id AS id, d.doc_id AS ord, replace(substr(d.text, 1, 80), chr(10), ' ') AS title,
    CASE WHEN d.doc_id % 5 <> 0 THEN substr(d.text, 1, 120) END AS summary,
    CASE WHEN d.doc_id % 11 <> 0 THEN p.url END AS url,
    ['hackernews','arxiv','reddit','rss','github','github_search','huggingface','webscraper'][(d.doc_id % 8 + 1)::INT] AS source,
    CASE WHEN d.doc_id % 13 <> 0 THEN ['models','papers','agents','products','tools','open_source','regulation'][(d.doc_id % 7 + 1)::INT] END AS topic,
    round(0.70::DOUBLE + (d.doc_id % 31) / 100.0::DOUBLE, 2) AS relevance_score,
    CASE WHEN d.doc_id % 10 <> 0 THEN (7 * d.n_chars + d.doc_id) % 700 END AS score,
    d.doc_id % 9 = 0 AS trending,
    CASE WHEN d.doc_id % 7 <> 0 THEN e.ts END AS published_at,
    TIMESTAMP '2024-01-15 00:00:00' + to_seconds((7919 * d.doc_id) % 1382400) AS created_at,
    coalesce(CASE WHEN d.doc_id % 7 <> 0 THEN e.ts END, TIMESTAMP '2024-01-15 00:00:00' + to_seconds((7919 * d.doc_id) % 1382400)) AS ed,
    'author' || (d.doc_id % 17) AS author, d.text AS full_text,
    CASE WHEN d.doc_id % 16 = 0 THEN '{"lane":"leading"}' ELSE '{}' END AS metadata,
    CASE WHEN d.doc_id % 4 <> 1 THEN round((d.doc_id * 37 % 101) / 100.0::DOUBLE, 2) END AS composite_score,
    (d.doc_id % 5 + 1)::INT AS priority
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
  LEFT JOIN events e ON e.event_id = (10 * d.doc_id) % (SELECT count(*) FROM events))
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pipeline_runs: one row per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("kind"),
        F.element_at(F.array(*map(F.lit, SOURCE_BY_ID)), (F.col("user_id") % 8 + 1).cast("int")).alias("source"),
        F.when(F.col("event_id") % 3 == 0, "error").when(F.col("event_id") % 5 == 0, "empty").otherwise("success").alias("status"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50).alias("items_extracted"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS run_id, ts AS started_at, event_type AS kind,
    ['hackernews','arxiv','reddit','rss','github','github_search','huggingface','webscraper'][(user_id % 8 + 1)::INT] AS source,
    CASE WHEN event_id % 3 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'empty' ELSE 'success' END AS status,
    CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS items_extracted
  FROM events)
"""
