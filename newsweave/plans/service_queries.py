"""Replies of the service (Q, K19, P26, T12, T14) and joins of replies, with their counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank
from ..sources import payloads
from . import pipeline
from .api import NewsApi
from .bindings import AS_OF, ITEMS_SQL, at, embeddings, items
from .registry import QUERIES, SQL, query

W = f"WITH {ITEMS_SQL}"


@query("Q19_by_source", W + "SELECT source, count(*) AS count FROM items GROUP BY source")
def q19(spark, sf):
    return NewsApi(items(spark, sf), AS_OF).by_source()


@query("K19_page_with_total", W + """, k AS (SELECT * FROM items WHERE trending AND ed >= TIMESTAMP '2024-01-05' AND ed < TIMESTAMP '2024-01-29')
SELECT id, title, source, topic, score, (SELECT count(*) FROM k) AS total FROM k ORDER BY ed DESC, id LIMIT 40 OFFSET 20""")
def k19(spark, sf):
    """A page and the number of all rows that its filters leave."""
    page, total = NewsApi(items(spark, sf), AS_OF).list_items(trending=True, date_from="2024-01-05", date_to="2024-01-28", limit=40, offset=20)
    return page.select("id", "title", "source", "topic", "score", F.lit(total).cast("long").alias("total"))


NEAR_SQL = """, q AS (SELECT embedding FROM embeddings WHERE vec_id = 11),
j AS (SELECT i.id AS item_id, i.ed, i.topic, 1 - list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM q)::DOUBLE[]) AS d FROM items i JOIN embeddings e ON e.vec_id = i.id)"""


@query("T12_fallback", W + NEAR_SQL + " SELECT item_id, round(d, 6) AS distance FROM j ORDER BY d, item_id LIMIT 25")
def t12(spark, sf):
    """Two months later nothing is recent, so all items are searched."""
    vectors = embeddings(spark, sf)
    found = rank.recent_or_all(items(spark, sf), vectors, rank.vector_of(vectors, 11), at("2024-04-01 00:00:00"), 25)
    return found.select("item_id", F.round("distance", 6).alias("distance"))


@query("T12_recent_topic", W + NEAR_SQL + " SELECT item_id, round(d, 6) AS distance FROM j WHERE topic = 'models' AND ed >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY ORDER BY d, item_id LIMIT 15")
def t12_recent(spark, sf):
    """Enough recent items of a topic: the others aren't searched."""
    vectors = embeddings(spark, sf)
    found = rank.recent_or_all(items(spark, sf), vectors, rank.vector_of(vectors, 11), at(), 15, days=20, topic="models")
    return found.select("item_id", F.round("distance", 6).alias("distance"))


@query("T14_page_of_ranked", W + """, p AS (SELECT id, composite_score, ed FROM items WHERE composite_score IS NOT NULL ORDER BY composite_score DESC, ed DESC, id LIMIT 200)
SELECT id, row_number() OVER (ORDER BY composite_score DESC, ed DESC, id)::INT AS rank FROM p QUALIFY rank > 25 AND rank <= 60""")
def t14(spark, sf):
    pool = items(spark, sf).where("composite_score is not null").orderBy(rank.by_composite(), rank.newest(), "id").limit(200)
    return rank.mmr(pool, 1.0, 60).where("rank > 25").select("id", "rank")


@query("J11_replies", W + """, b AS (SELECT id, (k // 10)::BIGINT AS batch, (k % 10)::INT AS pos FROM (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS k FROM items)),
r AS (SELECT *, 1 AS idx, 'models' AS topic, 0.9::DOUBLE AS relevance FROM b UNION ALL SELECT *, (batch % 12)::INT, 'tools', 0.8::DOUBLE FROM b UNION ALL SELECT *, 2, 'unknown', 0.9::DOUBLE FROM b UNION ALL SELECT *, 3, 'tools', 0.1::DOUBLE FROM b)
SELECT id, batch, pos, topic, relevance FROM r WHERE pos = idx AND topic <> 'unknown' AND relevance >= 0.5""")
def j11(spark, sf):
    """Indexes beyond the batch, unknown topics and low relevance are dropped; a repeated index repeats its row."""
    rows = pipeline.batches(items(spark, sf), 10).withColumn("pos", (F.row_number().over(Window.partitionBy("batch").orderBy("ord")) - 1).cast("int"))
    reply = F.concat(
        F.lit('Here you are: ```json\n[{"idx": 1, "topic": "models", "relevance": 0.9}, {"idx": '), F.col("batch") % 12, F.lit(', "topic": "tools", "relevance": 0.8}, '),
        F.lit('{"idx": 2, "topic": "unknown", "relevance": 0.9}, {"idx": 3, "topic": "tools", "relevance": 0.1}, {"idx": 99, "topic": "tools", "relevance": 0.9}]\n```'),
    )
    replies = rows.select("batch").distinct().select("batch", reply.alias("reply"))
    return pipeline.join_replies(rows, replies).select("id", "batch", "pos", "topic", "relevance")


S2, S8 = SQL["S2_leading_stories"], SQL["S8_models"]


def found_sources(spark, sf):
    raw = {"hackernews_leading": QUERIES["S2_leading_stories"](spark, sf), "huggingface": QUERIES["S8_models"](spark, sf)}
    missing = lambda df: [F.lit(None).cast("string").alias(c) for c in payloads.COLUMNS if c not in df.columns]
    return {k: df.select("*", *missing(df)) for k, df in raw.items()}


@query("S12_all_sources", f"SELECT 1 AS source_ord, title, score FROM ({S2}) UNION ALL SELECT 0 AS source_ord, title, score FROM ({S8})")
def s12(spark, sf):
    """Items of all enabled sources, in their order."""
    return payloads.union_sources(found_sources(spark, sf), ["huggingface", "reddit", "hackernews_leading"]).select("source_ord", "title", "score")


@query("U8_requested_sources", f"SELECT 0 AS source_ord, title, score FROM ({S2})")
def u8(spark, sf):
    """Of the enabled sources those that were asked for."""
    return payloads.union_sources(found_sources(spark, sf), ["huggingface", "hackernews_leading"], ["hackernews_leading", "rss"]).select("source_ord", "title", "score")
