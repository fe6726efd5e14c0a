"""Scans of landed payloads, made from whole tables, prompts and the search of many vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rank
from ..sources import payloads
from . import backfill, pipeline
from .bindings import ITEMS_SQL, embeddings, items, table
from .registry import query


def pages(rows: DataFrame, element: Column, wrap: str | None, by_month: bool = True) -> DataFrame:
    """Replies of up to 1,000 orders each, in order of their keys, as (month, ord, payload)."""
    keys = [F.date_format("o_orderdate", "yyyy-MM").alias("month")] if by_month else [F.lit("1992-01").alias("month")]
    listed = rows.groupBy(*keys, F.floor(F.col("o_orderkey") / 1000).alias("ord")).agg(F.array_sort(F.collect_list(element)).alias("e"))
    return listed.select("month", "ord", F.to_json(F.struct(F.col("e").alias(wrap)) if wrap else F.col("e")).alias("payload"))


def hit() -> Column:
    return F.struct(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("objectID"), F.concat(F.lit("story "), "o_orderkey").alias("title"),
        (F.col("o_orderkey") % 200).alias("points"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at_i"),
    )


def stamp() -> Column:
    return F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))


@query("S13_historical_stories", """SELECT source_id, title, score, published_s, month FROM (
SELECT o_custkey::VARCHAR AS source_id, 'story ' || o_orderkey AS title, o_orderkey % 200 AS score, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s,
  strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 200 > 50 AND day(o_orderdate) > 1) WHERE rn = 1""")
def s13(spark, sf):
    found = backfill.historical_hackernews(pages(table(spark, sf, "orders"), hit(), "hits"))
    return found.select("source_id", "title", "score", F.unix_timestamp("published_at").alias("published_s"), "month")


@query("S14_historical_repositories", """SELECT source_id, score, published_s, month FROM (
SELECT 'o/' || (o_custkey % 100) AS source_id, o_orderkey % 1000 AS score, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s,
  strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_custkey % 100 ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 1000 > 200) WHERE rn = 1""")
def s14(spark, sf):
    repo = F.struct(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("o/"), F.col("o_custkey") % 100).alias("full_name"),
        (F.col("o_orderkey") % 1000).alias("stargazers_count"), stamp().alias("pushed_at"),
    )
    found = backfill.historical_github(pages(table(spark, sf, "orders"), repo, "items"))
    return found.select("source_id", "score", F.unix_timestamp("published_at").alias("published_s"), "month")


@query("S15_historical_models", """SELECT source_id, score, published_s FROM (
SELECT 'm' || o_custkey AS source_id, o_orderkey % 500 AS score, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey // 1000, o_orderkey) AS rn
FROM orders WHERE o_orderkey % 500 >= 100 AND o_orderdate >= DATE '1994-03-01') WHERE rn = 1""")
def s15(spark, sf):
    name = F.concat(F.lit("m"), "o_custkey")
    model = F.struct(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, name).otherwise("").alias("modelId"), name.alias("id"),
        (F.col("o_orderkey") % 500).alias("downloads"), stamp().alias("lastModified"),
    )
    found = backfill.historical_huggingface(pages(table(spark, sf, "orders"), model, None, False), since="1994-03")
    return found.select("source_id", "score", F.unix_timestamp("published_at").alias("published_s"))


@query("S1_stories", """SELECT title, url, score, row_number() OVER (ORDER BY score DESC, ord)::INT AS place FROM (
SELECT 'story ' || o_orderkey AS title, 'https://news.ycombinator.com/item?id=' || o_custkey AS url, o_orderkey % 200 AS score, o_orderkey AS ord,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 200 > 10) WHERE rn = 1 ORDER BY place LIMIT 50""")
def s1(spark, sf):
    found = payloads.hackernews(pages(table(spark, sf, "orders"), hit(), "hits", False).select("ord", "payload"))
    ranked = rank.page(found.withColumn("id", F.col("ord")), F.col("score").desc(), limit=50)  # the reader's own cap
    return ranked.select("title", "url", "score", "place")


def documents(rows: DataFrame, entry: Column, head: str, tail: str) -> DataFrame:
    """Feeds or pages of up to 1,000 orders each, entries in order of their keys, as (ord, payload)."""
    listed = rows.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("es"))
    return listed.select("ord", F.concat(F.lit(head), F.concat_ws("", F.transform("es", lambda x: x["e"])), F.lit(tail)).alias("payload"))


def key() -> Column:
    return F.col("o_orderkey")


def customer() -> Column:
    return F.col("o_custkey")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def mail_date() -> Column:
    return F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))


def published() -> Column:
    return F.unix_timestamp("published_at").alias("published_s")


@query("S2_leading_stories", """SELECT title, url, score, published_s FROM (
SELECT 'story & ' || o_orderkey AS title, 'https://' || CASE o_orderkey % 3 WHEN 0 THEN 'openai.com' ELSE 'blog.mistral.ai' END || '/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 200 END AS score, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderdate > TIMESTAMP '1995-02-01') WHERE rn = 1""")
def s2(spark, sf):
    host = F.element_at(F.array(F.lit("openai.com"), F.lit("blog.mistral.ai"), F.lit("notopenai.com")), (key() % 3 + 1).cast("int"))
    story = F.struct(
        key().alias("k"), customer().cast("string").alias("objectID"), text("story &amp; ", key()).alias("title"), F.concat(F.lit("https://"), host, F.lit("/"), key()).alias("url"),
        F.when(key() % 7 != 0, key() % 200).alias("points"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at_i"),
    )
    found = payloads.hackernews_leading(pages(table(spark, sf, "orders"), story, "hits", False).select("ord", "payload"), since=791596800, cap=0)
    return found.select("title", "url", "score", published())


@query("S3_papers", """SELECT title, url, text, author, published_s, pdf_url FROM (
SELECT 'Paper ' || o_orderkey AS title, u AS url, 'new ' || CASE WHEN o_orderkey % 4 = 0 THEN 'Authors: P ' || o_orderkey || ' ' ELSE '' END || 'Abstract: ' || w || ' of ' || o_orderkey AS text,
  CASE WHEN o_orderkey % 6 = 0 THEN 'N, M' WHEN o_orderkey % 4 = 0 THEN 'P ' || o_orderkey ELSE 'unknown' END AS author, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s, replace(u, '/abs/', '/pdf/') AS pdf_url, w,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM (SELECT *, 'https://arxiv.org/abs/24.' || o_custkey || 'v' || (o_orderkey % 3) AS u, CASE WHEN o_orderkey % 2 = 0 THEN 'LLMs' ELSE 'plants' END AS w FROM orders) WHERE o_orderkey % 5 <> 0) WHERE rn = 1 AND w = 'LLMs'""")
def s3(spark, sf):
    about = F.when(key() % 2 == 0, "LLMs").otherwise("plants")
    named = F.when(key() % 4 == 0, text("Authors: P ", key(), "\n")).otherwise("")
    creators = F.when(key() % 6 == 0, "<author><name>N</name></author><author><name>M</name></author>").otherwise("")
    entry = F.concat(
        text("<item><title>Paper ", key(), "</title><link>https://arxiv.org/abs/24.", customer(), "v", key() % 3, "</link><description>Announce Type: "),
        F.when(key() % 5 != 0, "new").otherwise("replace"), F.lit("\n"), named, text("Abstract: ", about, " of ", key(), "</description>"), creators,
        F.lit("<pubDate>"), mail_date(), F.lit("</pubDate></item>"),
    )
    found = payloads.arxiv(documents(table(spark, sf, "orders"), entry, "<rss><channel>", "</channel></rss>"), ("LLM", "agent"), cap=0)
    return found.select("title", "url", "text", "author", published(), F.get_json_object("metadata", "$.pdf_url").alias("pdf_url"))


@query("S4_posts", """SELECT title, url, text, score, published_s FROM (
SELECT 'post ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.reddit.com/r/x/' || o_orderkey ELSE 'https://x.org/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'text ' || o_orderkey ELSE 'post ' || o_orderkey END AS text, o_orderkey % 300 AS score, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 11 <> 0) WHERE rn = 1""")
def s4(spark, sf):
    post = F.struct(key().alias("k"), F.struct(
        text("r", customer()).alias("id"), text("post ", key()).alias("title"), text("https://x.org/", key()).alias("url"), text("/r/x/", key()).alias("permalink"),
        F.when(key() % 3 != 0, text("text ", key())).otherwise("").alias("selftext"), (key() % 2 == 0).alias("is_self"), (key() % 11 == 0).alias("stickied"),
        (key() % 300).alias("score"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_utc"),
    ).alias("data"))
    rows = pages(table(spark, sf, "orders"), post, "children", False)
    found = payloads.reddit(rows.select("ord", F.concat(F.lit('{"data": '), "payload", F.lit("}")).alias("payload")), cap=0)
    return found.select("title", "url", "text", "score", published())


@query("S5_feeds", """SELECT title, url, text, author, published_s FROM (
SELECT 'News ' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ' - Other' ELSE '' END AS title, 'https://n.example.com/' || o_custkey AS url, 'Text ' || o_orderkey || ' & more' AS text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'A' || o_custkey END AS author, CASE WHEN o_orderkey % 6 <> 0 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT END AS published_s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders) WHERE rn = 1 AND (published_s IS NULL OR published_s >= epoch(TIMESTAMP '1997-01-01'))""")
def s5(spark, sf):
    entry = F.concat(
        text("<item><title>News ", key()), F.when(key() % 4 == 0, " - Other").otherwise(" - Pub"), text("</title><link>https://n.example.com/", customer(), "</link>"),
        text("<description>&lt;p&gt;Text ", key(), " &amp;amp;  more&lt;/p&gt;</description><source>Pub</source>"),
        F.when(key() % 5 == 0, text("<author>A", customer(), "</author>")).otherwise(""),
        F.when(key() % 6 != 0, F.concat(F.lit("<pubDate>"), mail_date(), F.lit("</pubDate>"))).otherwise(""), F.lit("</item>"),
    )
    feeds = documents(table(spark, sf, "orders"), entry, "<rss><channel>", "</channel></rss>")
    return payloads.rss(feeds, F.lit("1997-01-01").cast("timestamp"), cap=0).select("title", "url", "text", "author", published())


@query("S6_trending", """SELECT title, url, author, score, stars_today FROM (
SELECT 'o' || o_custkey || '/r' || (o_custkey % 7) || ': An LLM & ' || o_orderkey AS title, 'https://github.com/o' || o_custkey || '/r' || (o_custkey % 7) AS url, 'o' || o_custkey AS author,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1000 + o_orderkey END AS score, (o_orderkey % 50)::VARCHAR AS stars_today, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 2 = 0) WHERE rn = 1""")
def s6(spark, sf):
    name = text("/o", customer(), "/r", customer() % 7)
    row = F.concat(
        F.lit('<article class="Box-row"><h2 class="h3">\n<a href="'), name, F.lit('">x</a></h2>\n<p class="c">An '), F.when(key() % 2 == 0, "LLM").otherwise("plant"), text(" &amp; <b>", key(), "</b></p>"),
        F.lit('<span itemprop="programmingLanguage">Rust</span>'),
        F.when(key() % 9 != 0, F.concat(F.lit('<a href="'), name, F.lit('/stargazers" class="d"> <svg></svg> '), F.format_number(key() + 1000, 0), F.lit("\n</a>"))).otherwise(""), text("<span>", key() % 50, " stars today</span></article>"),
    )
    found = payloads.github_trending(documents(table(spark, sf, "orders"), row, "<main>", "</main>"), F.lit("2024-01-01").cast("timestamp"), cap=0)
    return found.select("title", "url", "author", "score", F.get_json_object("metadata", "$.stars_today").alias("stars_today"))


@query("S7_repositories", """SELECT title, url, author, score, published_s FROM (
SELECT 'o/' || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN ': about ' || o_orderkey ELSE '' END AS title, 'https://github.com/o/' || o_custkey AS url, 'u' || (o_orderkey % 5) AS author, o_orderkey % 1000 AS score,
  epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 1000 > 200) WHERE rn = 1 AND (o_orderkey % 8 = 0 OR floor((epoch(TIMESTAMP '2001-08-02') - epoch(o_orderdate::TIMESTAMP)) / 86400) <= 1500)""")
def s7(spark, sf):
    repo = F.struct(
        key().alias("k"), text("o/", customer()).alias("full_name"), text("https://github.com/o/", customer()).alias("html_url"), F.when(key() % 3 > 0, text("about ", key())).alias("description"),
        (key() % 1000).alias("stargazers_count"), F.when(key() % 8 != 0, stamp()).alias("created_at"), stamp().alias("pushed_at"), F.struct(text("u", key() % 5).alias("login")).alias("owner"),
    )
    rows = pages(table(spark, sf, "orders"), repo, "items", False).select("ord", "payload")
    found = payloads.github_search(rows, F.lit("2001-08-02").cast("timestamp"), max_age_days=1500, cap=0)
    return found.select("title", "url", "author", "score", published())


@query("S8_models", """SELECT title, text, author, score, published_s FROM (
SELECT 'org' || (o_custkey % 10) || '/m' || o_custkey AS title, 'org' || (o_custkey % 10) || '/m' || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN ' | Task: t' || (o_orderkey % 3) ELSE '' END || ' | Library: lib' AS text,
  'org' || (o_custkey % 10) AS author, o_orderkey % 500 AS score, CASE WHEN o_orderkey % 7 > 0 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT END AS published_s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders WHERE o_orderkey % 500 >= 100 AND o_orderkey % 4 > 0 AND o_orderkey % 9 > 0 AND (o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '1998-01-01')) WHERE rn = 1""")
def s8(spark, sf):
    model = F.struct(
        key().alias("k"), text("org", customer() % 10, "/m", customer()).alias("id"), F.when(key() % 3 > 0, text("t", key() % 3)).otherwise("").alias("pipeline_tag"), F.when(key() % 9 > 0, "lib").alias("library_name"),
        (key() % 500).alias("downloads"), F.when(key() % 4 == 0, F.array(F.lit("base_model:quantized:x"))).otherwise(F.array(F.lit("en"))).alias("tags"), F.when(key() % 7 > 0, stamp()).alias("lastModified"),
    )
    rows = pages(table(spark, sf, "orders"), model, None, False).select("ord", "payload")
    found = payloads.huggingface_models(rows, F.lit("1998-01-01").cast("timestamp"), cap=0)
    return found.select("title", "text", "author", "score", published())


@query("S9_daily_papers", """SELECT title, url, text, score, published_s, has_abstract FROM (
SELECT 'Paper ' || o_orderkey AS title, 'https://huggingface.co/papers/24.' || o_custkey AS url, concat_ws(chr(10), 'Paper ' || o_orderkey, p_name) AS text, o_orderkey % 90 AS score,
  epoch(o_orderdate::TIMESTAMP)::BIGINT AS published_s, (p_name IS NOT NULL)::VARCHAR AS has_abstract, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
FROM orders LEFT JOIN part ON p_partkey = o_custkey AND p_size > 10 WHERE o_orderkey % 13 > 0) WHERE rn = 1""")
def s9(spark, sf):
    paper = F.struct(key().alias("k"), F.struct(
        F.when(key() % 13 > 0, text("24.", customer())).otherwise("").alias("id"), text("Paper ", key()).alias("title"), (key() % 90).alias("upvotes"), stamp().alias("publishedAt")
    ).alias("paper"))
    rows = pages(table(spark, sf, "orders"), paper, None, False).select("ord", "payload")
    abstracts = table(spark, sf, "part").where("p_size > 10").select(text("24.", F.col("p_partkey"), "v", F.col("p_size")).alias("arxiv_id"), F.col("p_name").alias("abstract"))
    found = payloads.huggingface_papers(rows, abstracts)
    return found.select("title", "url", "text", "score", published(), F.get_json_object("metadata", "$.has_abstract").alias("has_abstract"))


@query("F32_prompts", f"""WITH {ITEMS_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS k FROM items)
SELECT (k // 10)::BIGINT AS batch, count(*) AS n,
  'Classify: models, papers, agents, products, tools, open_source, regulation' || string_agg(chr(10) || '[' || (k % 10) || '] title: ' || coalesce(title, '') || chr(10) || '    source: ' || source
    || ' | score: ' || coalesce(score, 0) || chr(10) || '    text: ' || substr(coalesce(full_text, ''), 1, 200), '' ORDER BY k) || chr(10) AS prompt
FROM placed GROUP BY 1""")
def f32(spark, sf):
    return pipeline.prompts(items(spark, sf), template=("Classify: models, papers, agents, products, tools, open_source, regulation", "\n"))


@query("Q10_similar_to_many", """WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS item_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, item_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.distance, item_id) <= 10""")
def q10_many(spark, sf):
    vectors = embeddings(spark, sf)
    found = rank.nearest_of_all(vectors, vectors.where("item_id % 50 = 0"), 10)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"))
