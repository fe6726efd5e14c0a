"""Lists, filters, statistics, audit and search over items (P, A, W, T, Q)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import SOURCES
from ..functions import scalars as S
from ..operators import dedup, filters, rank, search_index, stats, store
from .bindings import ITEMS_SQL, RUNS_SQL, at, embeddings, items, runs, searched, table
from .registry import SQL, query, same

DAY, TODAY = "2024-01-25", "2024-01-30"
W = f"WITH {ITEMS_SQL}"
WR = f"WITH {RUNS_SQL}"
LISTED = ["id", "title", "source", "topic", "score", "ed"]


# Q1-Q12: listings

@query("Q1_items", W + """SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY ed DESC, id)::INT AS place FROM items
WHERE topic = 'models' AND ed >= TIMESTAMP '2024-01-10' AND ed < TIMESTAMP '2024-01-29' ORDER BY ed DESC, id LIMIT 50""")
def q1(spark, sf):
    kept = filters.where_given(items(spark, sf), topic="models", source="").where(filters.between_days("ed", "2024-01-10", "2024-01-28"))
    return rank.page(kept, rank.newest(), limit=50).select(*LISTED, "place")


@query("Q1_items_second_page", W + """SELECT * FROM (SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY ed DESC, id)::INT AS place FROM items
WHERE source = 'reddit' AND NOT trending) WHERE place > 20 AND place <= 40""")
def q1b(spark, sf):
    kept = filters.where_given(items(spark, sf), trending=False, source="reddit")
    return rank.page(kept, rank.newest(), limit=20, offset=20).select(*LISTED, "place")


@query("Q2_count", W + "SELECT count(*) AS total FROM items WHERE source = 'arxiv' AND ed >= TIMESTAMP '2024-01-10'")
def q2(spark, sf):
    return filters.where_given(items(spark, sf), source="arxiv").where(filters.between_days("ed", "2024-01-10", None)).agg(F.count("*").alias("total"))


@query("Q3_by_date", W + f"""SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY score DESC NULLS LAST, ed DESC, id)::INT AS place FROM items
WHERE ed >= TIMESTAMP '{DAY}' AND ed < TIMESTAMP '{DAY}' + INTERVAL 1 DAY ORDER BY place LIMIT 200""")
def q3(spark, sf):
    return rank.page(items(spark, sf).where(filters.on_day("ed", DAY)), rank.by_score(), rank.newest(), limit=200).select(*LISTED, "place")


@query("Q4_trending", W + """SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY score DESC NULLS LAST, ed DESC, id)::INT AS place FROM items
WHERE trending AND ed >= TIMESTAMP '2024-01-24' ORDER BY place LIMIT 20""")
def q4(spark, sf):
    kept = items(spark, sf).where(F.col("trending") & (F.col("ed") >= filters.since_days(at(), 7)))
    return rank.page(kept, rank.by_score(), rank.newest(), limit=20).select(*LISTED, "place")


@query("Q5_today", W + f"""SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY ed DESC, id)::INT AS place FROM items
WHERE ed >= TIMESTAMP '{TODAY}' AND ed < TIMESTAMP '{TODAY}' + INTERVAL 1 DAY ORDER BY place LIMIT 50""")
def q5(spark, sf):
    return rank.page(items(spark, sf).where(filters.on_day("ed", TODAY)), rank.newest(), limit=50).select(*LISTED, "place")


@query("Q6_top", W + """SELECT id, title, composite_score, row_number() OVER (ORDER BY composite_score DESC NULLS LAST, id)::INT AS place FROM items
WHERE composite_score IS NOT NULL AND ed >= TIMESTAMP '2024-01-24' ORDER BY place LIMIT 10""")
def q6(spark, sf):
    kept = items(spark, sf).where(F.col("composite_score").isNotNull() & (F.col("ed") >= filters.since_days(at(), 7)))
    return rank.page(kept, rank.by_composite(), limit=10).select("id", "title", "composite_score", "place")


@query("Q7_feed")
def q7(spark, sf):
    page, _ = rank.feed(items(spark, sf), at(), limit=20)
    return page.select("id", "title", "source", "topic", "composite_score", "rank")


@query("Q7_candidates", W + """, n AS (SELECT count(*) FILTER (ed >= TIMESTAMP '2024-01-29') AS h48, count(*) FILTER (ed >= TIMESTAMP '2024-01-28') AS h72 FROM items WHERE composite_score IS NOT NULL),
lim AS (SELECT CASE WHEN h48 >= 5 THEN TIMESTAMP '2024-01-29' WHEN h72 >= 5 THEN TIMESTAMP '2024-01-28' ELSE TIMESTAMP '2024-01-24' END AS t FROM n)
SELECT id, composite_score FROM items WHERE composite_score IS NOT NULL AND ed >= (SELECT t FROM lim) ORDER BY composite_score DESC, ed DESC, id LIMIT 100""")
def q7c(spark, sf):
    pool = rank.candidates(items(spark, sf), at(), 20, live=False)
    return pool.select("id", "composite_score")


@query("Q8_recent", W + """SELECT id, title, source, topic, score, ed, row_number() OVER (ORDER BY ed DESC, id)::INT AS place FROM items
WHERE ed >= TIMESTAMP '2024-01-29' ORDER BY place LIMIT 50""")
def q8(spark, sf):
    return rank.page(items(spark, sf).where(F.col("ed") >= filters.since_hours(at(), 48)), rank.newest(), limit=50).select(*LISTED, "place")


RESPONSE = ["id", "title", "summary", "url", "source", "topic", "relevance_score", "priority", "trending", "published_at", "created_at", "author", "score", "composite_score"]


@query("Q9_item", W + f"SELECT {', '.join(RESPONSE)} FROM items WHERE id = 42")
def q9(spark, sf):
    return items(spark, sf).where("id = 42").select(*RESPONSE)


@query("Q10_similar", """SELECT e.vec_id AS item_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 10""")
def q10(spark, sf):
    vectors = embeddings(spark, sf)
    one = rank.vector_of(vectors, 7)
    return rank.nearest(vectors.where("item_id <> 7"), one, 10).select("item_id", F.round("distance", 6).alias("distance"))


@query("Q11_briefing_items", W + f"""SELECT id, title, score, (SELECT count(*) FROM items WHERE ed >= TIMESTAMP '{DAY}' AND ed < TIMESTAMP '{DAY}' + INTERVAL 1 DAY) AS total
FROM items WHERE ed >= TIMESTAMP '{DAY}' AND ed < TIMESTAMP '{DAY}' + INTERVAL 1 DAY ORDER BY score DESC NULLS LAST, id LIMIT 20""")
def q11(spark, sf):
    day = items(spark, sf).where(filters.on_day("ed", DAY))
    return rank.page(day, rank.by_score(), limit=20).select("id", "title", "score", day.agg(F.count("*")).scalar().alias("total"))


BRIEFINGS_SQL = """b AS (SELECT ts::DATE AS date, count(*) AS total_items, sum(event_id % 20)::BIGINT AS items_extracted, list_sort(list(DISTINCT event_type)) AS sources FROM events GROUP BY 1)"""


def briefings(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("total_items"), F.sum(F.col("event_id") % 20).alias("items_extracted"), F.array_sort(F.collect_set("event_type")).alias("sources")
    )


@query("Q12_briefings", f"WITH {BRIEFINGS_SQL} SELECT date, total_items, items_extracted, (SELECT count(*) FROM b) AS total FROM b ORDER BY date DESC LIMIT 7 OFFSET 7")
def q12(spark, sf):
    b = briefings(spark, sf)
    total = b.agg(F.count("*")).scalar().alias("total")
    return b.orderBy(F.col("date").desc()).offset(7).limit(7).select("date", "total_items", "items_extracted", total)


WORDS_SQL = r"regexp_extract_all(lower(concat_ws(' ', title, full_text, source)), '[\p{L}\p{N}_]+')"


@query("Q13_search", W + f""", s AS (SELECT id, title, source, summary, {WORDS_SQL} AS words FROM items),
m AS (SELECT id, (list_contains(words, 'the') AND list_contains(words, 'reddit')) AS full_match,
 (coalesce(title ILIKE '%the reddit%', false) OR coalesce(source ILIKE '%the reddit%', false) OR coalesce(summary ILIKE '%the reddit%', false)) AS like_match,
 len(list_filter(words, lambda w: w = 'the')) AS a, len(list_filter(words, lambda w: w = 'reddit')) AS b FROM s)
SELECT id, round(CASE WHEN full_match THEN ln(1 + a) + ln(1 + b) ELSE 0 END, 6) AS rank FROM m WHERE full_match OR like_match
ORDER BY round(CASE WHEN full_match THEN ln(1 + a) + ln(1 + b) ELSE 0 END, 6) DESC, id LIMIT 50""")
def q13(spark, sf):
    return search(items(spark, sf), "the reddit", 50)


def search(df, text: str, limit: int, sort_by: str = "relevance"):
    """Full-text or contains; by rank, date or score."""
    words = store.search_words(df)
    marked = df.withColumn("_words", words).withColumn("rank", F.round(rank.text_rank(F.col("_words"), filters.query_words(text)), 6))
    kept = marked.where(filters.matches_all(F.col("_words"), text) | filters.contains_any(text, "title", "source", "summary"))
    order = {"relevance": [F.col("rank").desc()], "date": [rank.newest()], "score": [rank.by_score()]}[sort_by]
    return kept.orderBy(*order, "id").limit(limit).select("id", "rank")


def indexed(spark, sf) -> str:
    """A search index of the items in the shared folder."""
    path = f"{dedup.shared_folder(spark)}/search-{uuid.uuid4().hex}"
    search_index.write_batch(searched(spark, sf), path, 0)
    return path


@query("Q13_search_index", SQL["Q13_search"])
def q13_index(spark, sf):
    return search_indexed(searched(spark, sf), indexed(spark, sf), "the reddit", 50)


def search_indexed(df, path: str, text: str, limit: int):
    """As search() by rank, with an index: words from postings, and contains on the short columns."""
    like = df.where(filters.contains_any(text, "title", "source", "summary")).select("id", F.lit(0.0).alias("rank"))
    both = search_index.full_text(df.sparkSession, path, text).unionByName(like).groupBy("id").agg(F.round(F.max("rank"), 6).alias("rank"))
    return both.orderBy(F.col("rank").desc(), "id").limit(limit)


@query("Q13_search_like", W + """SELECT id, 0.0::DOUBLE AS rank FROM items WHERE coalesce(title ILIKE '%th_s%', false) OR coalesce(source ILIKE '%th_s%', false) OR coalesce(summary ILIKE '%th_s%', false)
ORDER BY score DESC NULLS LAST, id LIMIT 30""")
def q13b(spark, sf):
    kept = items(spark, sf).where(filters.contains_any("th_s", "title", "source", "summary"))
    return kept.orderBy(rank.by_score(), "id").limit(30).select("id", F.lit(0.0).alias("rank"))


@query("Q14_semantic", W + """, q AS (SELECT embedding FROM embeddings WHERE vec_id = 11),
j AS (SELECT i.id AS item_id, i.ed, 1 - list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM q)::DOUBLE[]) AS d FROM items i JOIN embeddings e ON e.vec_id = i.id),
r AS (SELECT * FROM j WHERE ed >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
c AS (SELECT * FROM r UNION ALL SELECT * FROM j WHERE (SELECT count(*) FROM r) < 10 AND item_id NOT IN (SELECT item_id FROM r))
SELECT item_id, round(d, 6) AS distance FROM c ORDER BY d, item_id LIMIT 10""")
def q14(spark, sf):
    vectors = embeddings(spark, sf)
    return rank.recent_or_all(items(spark, sf), vectors, rank.vector_of(vectors, 11), at(), 10).select("item_id", F.round("distance", 6).alias("distance"))


@query("Q15_context", W + """, p AS (SELECT *, row_number() OVER (ORDER BY ed DESC, id) AS place FROM items ORDER BY ed DESC, id LIMIT 5)
SELECT id, place::INT AS place, concat_ws(chr(10), '[' || place || '] ' || title, 'Source: ' || source, 'Topic: ' || topic, 'Date: ' || strftime(published_at, '%Y-%m-%d'),
 CASE WHEN summary <> '' THEN 'Summary: ' || summary END, CASE WHEN url <> '' THEN 'URL: ' || url END) AS block FROM p""")
def q15(spark, sf):
    from .pipeline import context_blocks

    return context_blocks(rank.page(items(spark, sf), rank.newest(), limit=5))


@query("Q16_topics", "SELECT unnest(['models','papers','agents','products','tools','open_source','regulation']) AS topic")
def q16(spark, sf):
    from ..config import TOPICS

    return spark.createDataFrame([(t,) for t in TOPICS], "topic string")


@query("Q17_sources", W + "SELECT source, count(*) AS count FROM items GROUP BY source")
def q17(spark, sf):
    return stats.count_by(items(spark, sf), "source")


# Q18-Q28: statistics and audit

@query("A1_summary", W + f"""SELECT count(*) AS total_items, count(*) FILTER (ed >= TIMESTAMP '{TODAY}' AND ed < TIMESTAMP '{TODAY}' + INTERVAL 1 DAY) AS items_today,
count(DISTINCT source) AS sources, count(DISTINCT topic) AS topics, count(*) FILTER (trending AND ed >= TIMESTAMP '{TODAY}' AND ed < TIMESTAMP '{TODAY}' + INTERVAL 1 DAY) AS trending_today FROM items""")
def a1(spark, sf):
    return stats.summary(items(spark, sf), TODAY)


@query("A3_by_topic", W + "SELECT topic, count(*) AS count FROM items WHERE topic IS NOT NULL GROUP BY topic")
def a3(spark, sf):
    return stats.count_by(items(spark, sf).where("topic is not null"), "topic")


@query("A4_by_date", W + "SELECT ed::DATE AS date, count(*) AS count FROM items WHERE ed >= TIMESTAMP '2024-01-01' GROUP BY 1")
def a4(spark, sf):
    return stats.by_date(items(spark, sf).where(F.col("ed") >= filters.since_days(at(), 30)))


@query("A5_by_topic_date", W + "SELECT ed::DATE AS date, topic, count(*) AS count FROM items WHERE topic IS NOT NULL AND ed >= TIMESTAMP '2024-01-10' AND ed < TIMESTAMP '2024-01-21' GROUP BY 1, 2")
def a5(spark, sf):
    first, last = filters.check_range("2024-01-10", "2024-01-20")
    return stats.by_date(items(spark, sf).where(F.col("topic").isNotNull() & filters.between_days("ed", first, last)), "topic")


@query("A6_by_source_date", W + "SELECT ed::DATE AS date, source, count(*) AS count FROM items WHERE ed >= TIMESTAMP '2024-01-17' GROUP BY 1, 2")
def a6(spark, sf):
    return stats.by_date(items(spark, sf).where(F.col("ed") >= filters.since_days(at(), 14)), "source")


@query("A7_trending_timeline", W + "SELECT ed::DATE AS date, count(*) AS count FROM items WHERE trending AND ed >= TIMESTAMP '2024-01-01' GROUP BY 1")
def a7(spark, sf):
    return stats.by_date(items(spark, sf).where(F.col("trending") & (F.col("ed") >= filters.since_days(at(), 30))))


@query("A8_score_histogram", W + """SELECT r.range, r.min::INT AS min, r.max::INT AS max, (SELECT count(*) FROM items WHERE score IS NOT NULL AND score >= r.min AND score <= r.hi) AS count
FROM (VALUES ('0-10', 0, 10, 10), ('11-50', 11, 50, 50), ('51-100', 51, 100, 100), ('101-250', 101, 250, 250), ('251-500', 251, 500, 500), ('501+', 501, 999999, 99999999)) r(range, min, max, hi)""")
def a8(spark, sf):
    return stats.score_histogram(items(spark, sf).where("score is not null"))


@query("A9_audit_totals", W + "SELECT count(*) AS total, min(created_at) AS oldest, max(created_at) AS newest FROM items")
def a9(spark, sf):
    return stats.audit_totals(items(spark, sf))


@query("A10_audit_sources", W + "SELECT source, count(*) AS count, max(created_at) AS latest FROM items GROUP BY source")
def a10(spark, sf):
    return stats.audit_sources(items(spark, sf))


@query("A11_audit_daily", W + "SELECT created_at::DATE AS date, source, count(*) AS count FROM items WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2")
def a11(spark, sf):
    return stats.by_date(items(spark, sf).where(F.col("created_at") >= at() - F.make_dt_interval(days=F.lit(7))), "source", ts="created_at")


@query("A12_score_distribution", W + "SELECT source, count(composite_score) AS count, avg(composite_score) AS avg, min(composite_score) AS min, max(composite_score) AS max FROM items GROUP BY source")
def a12(spark, sf):
    return stats.score_distribution(items(spark, sf))


@query("A13_duplicate_groups", W + "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM items WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)")
def a13(spark, sf):
    return stats.duplicate_groups(items(spark, sf))


@query("A14_freshness", W + """, f AS (SELECT source, max(created_at) AS latest, round_even((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(created_at))) / 1e6 / 3600, 1) AS hours FROM items GROUP BY source)
SELECT *, CASE WHEN hours <= 2 THEN 'ok' WHEN hours <= 24 THEN 'stale' ELSE 'dead' END AS status FROM f""")
def a14(spark, sf):
    return stats.source_freshness(items(spark, sf), at())


@query("A18_run_listing", WR + "SELECT run_id, started_at, status, coalesce(items_extracted, 0) AS items_extracted FROM runs WHERE status = 'error' ORDER BY started_at DESC, run_id LIMIT 50")
def a18(spark, sf):
    kept = filters.where_given(runs(spark, sf), status="error")
    return kept.orderBy(F.col("started_at").desc(), "run_id").limit(50).select("run_id", "started_at", "status", F.coalesce("items_extracted", F.lit(0)).alias("items_extracted"))


@query("A19_windowed_counts", "SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-29 23:00:00') AS last_hour, count(*) FILTER (ts >= TIMESTAMP '2024-01-29') AS today FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY user_id HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-29') > 0")
def a19(spark, sf):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events").where(F.col("ts") < now)
    today = F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") > F.lit("2024-01-29 23:00:00").cast("timestamp_ntz")).alias("last_hour"), F.count_if(today).alias("today")).where("today > 0")


@query("A26_run_counters", WR + "SELECT status, count(*) AS runs, sum(coalesce(items_extracted, 0))::BIGINT AS extracted FROM runs GROUP BY status")
def a26(spark, sf):
    return runs(spark, sf).groupBy("status").agg(F.count("*").alias("runs"), F.sum(F.coalesce("items_extracted", F.lit(0))).alias("extracted"))


@query("A27_running_cost", """WITH b AS (SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens_in, count(*) * 45 AS tokens_out FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, tokens_in * 0.20::DOUBLE / 1e6::DOUBLE + tokens_out * 2.00::DOUBLE / 1e6::DOUBLE AS cost FROM b), t AS (SELECT conv_id, cost, sum(cost) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT conv_id, round(cost, 9) AS cost, round(total, 9) AS total, (total - cost) < 0.03 AS runs, CASE WHEN total >= 0.03 THEN 'stop' WHEN total >= 0.8 * 0.03 THEN 'warn' ELSE 'ok' END AS state FROM t""")
def a27(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens_in"), (F.count("*") * 45).alias("tokens_out"))
    return stats.running_cost(c, "conv_id", 0.03).select("conv_id", F.round("cost", 9).alias("cost"), F.round("total", 9).alias("total"), "runs", "state")


@query("A28_dry_run_estimate", WR + "SELECT source, count(*) AS n, round(count(*) * (170 * 0.20::DOUBLE + 45 * 2.00::DOUBLE) / 1e6, 9) AS cost FROM runs GROUP BY source")
def a28(spark, sf):
    return runs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.round(F.count("*") * (170 * 0.20 + 45 * 2.00) / 1e6, 9).alias("cost"))


PIVOT = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in SOURCES)


@query("A29_source_date_pivot", W + f"SELECT ed::DATE AS date, {PIVOT} FROM items GROUP BY 1")
def a29(spark, sf):
    return stats.source_date_pivot(items(spark, sf), SOURCES)


@query("A30_shares", W + "SELECT source, count(*) AS count, round(count(*) / (SELECT count(*) FROM items)::DOUBLE * 100, 1) AS share FROM items GROUP BY source")
def a30(spark, sf):
    return stats.shares(stats.count_by(items(spark, sf), "source"))


@query("A31_calendar", W + """, d AS (SELECT ed::DATE AS date, count(*) AS count FROM items GROUP BY 1), t AS (SELECT max(count) AS top FROM d)
SELECT date, count, (CASE WHEN count = 0 THEN 0 WHEN count / top::DOUBLE <= 0.25 THEN 1 WHEN count / top::DOUBLE <= 0.5 THEN 2 WHEN count / top::DOUBLE <= 0.75 THEN 3 ELSE 4 END)::INT AS level FROM d, t""")
def a31(spark, sf):
    return stats.calendar_levels(stats.by_date(items(spark, sf)))


@query("A32_day_summary", W + f"SELECT count(*) AS items, count(DISTINCT coalesce(topic, 'uncategorized')) AS topics FROM items WHERE ed >= TIMESTAMP '{DAY}' AND ed < TIMESTAMP '{DAY}' + INTERVAL 1 DAY")
def a32(spark, sf):
    return stats.day_summary(items(spark, sf), DAY)


# Predicates

@query("P8_nulls", W + "SELECT count(*) FILTER (composite_score IS NULL) AS unscored, count(*) FILTER (topic IS NOT NULL) AS with_topic, count(*) FILTER (url IS NOT NULL) AS with_url FROM items")
def p8(spark, sf):
    return items(spark, sf).agg(F.count_if(F.col("composite_score").isNull()).alias("unscored"), F.count_if(F.col("topic").isNotNull()).alias("with_topic"), F.count_if(F.col("url").isNotNull()).alias("with_url"))


@query("P11_full_text", W + f"SELECT id FROM (SELECT id, {WORDS_SQL} AS words FROM items) WHERE list_contains(words, 'the') AND list_contains(words, 'of') AND list_contains(words, 'license')")
def p11(spark, sf):
    return items(spark, sf).where(filters.matches_all(store.search_vector(), "The license OF")).select("id")


@query("P11_full_text_index", SQL["P11_full_text"])
def p11_index(spark, sf):
    return search_index.full_text(spark, indexed(spark, sf), "The license OF").select("id")


@query("P13_validation", W + "SELECT id, list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'missing or empty title' END, CASE WHEN coalesce(trim(url), '') = '' THEN 'missing or empty url' END], lambda x: x IS NOT NULL) AS errors FROM items")
def p13(spark, sf):
    return items(spark, sf).select("id", filters.errors().alias("errors"))


@query("P18_engaged", W + "SELECT id FROM items WHERE source NOT IN ('hackernews', 'reddit') OR metadata LIKE '%leading%' OR coalesce(score, 0) >= 5")
def p18(spark, sf):
    return items(spark, sf).where(filters.engaged(5)).select("id")


@query("P24_trusted_domain", "SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\\.)(example\\.com|example\\.org)$') AS trusted FROM pages")
def p24(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.host_in(S.host("url"), ("example.com", "example.org")).alias("trusted"))


@query("P25_response", W + f"SELECT {', '.join(RESPONSE)} FROM items")
def p25(spark, sf):
    return items(spark, sf).select(*RESPONSE)


# Windows and joins

@query("W1_duplicate_urls", W + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY substr(sha256(url), 1, 16) ORDER BY composite_score DESC NULLS LAST, created_at DESC, id) AS rn FROM items WHERE url <> '') WHERE rn > 1")
def w1(spark, sf):
    return dedup.duplicate_urls(items(spark, sf)).select("id")


@query("W7_batches", W + "SELECT id, ((row_number() OVER (ORDER BY ord) - 1) // 25)::BIGINT AS batch FROM items")
def w7(spark, sf):
    from .pipeline import batches

    return batches(items(spark, sf), 25).select("id", "batch")


@query("J1_items_embeddings", W + "SELECT i.id, e.label, len(e.embedding) AS n FROM items i JOIN embeddings e ON e.vec_id = i.id")
def j1(spark, sf):
    e = embeddings(spark, sf)
    return items(spark, sf).join(e, F.col("id") == F.col("item_id")).select("id", "label", F.size("embedding").cast("long").alias("n"))


@query("J2_missing_embeddings", W + "SELECT id FROM items WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = items.id) ORDER BY id LIMIT 500")
def j2(spark, sf):
    from ..streaming.jobs import missing_embeddings

    return missing_embeddings(items(spark, sf).select("id"), embeddings(spark, sf))


@query("J3_unseen_by_url", W + """SELECT n.id FROM items n WHERE n.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM items s WHERE s.id % 2 = 1 AND s.created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND s.url = n.url AND s.url <> '')""")
def j3(spark, sf):
    i = items(spark, sf)
    return dedup.unseen_by_url(i.where("id % 2 = 0"), i.where("id % 2 = 1"), at()).select("id")


@query("J5_host_semi", "SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\\.)example\\.com$')")
def j5(spark, sf):
    return table(spark, sf, "pages").where(S.host_in(S.host("url"), ("example.com",))).select("page_id")


@query("J8_absent_hashes_all", W + "SELECT id FROM items n WHERE n.id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM items s WHERE s.id % 3 <> 0 AND sha256(s.title || '|' || coalesce(s.url, '')) = sha256(n.title || '|' || coalesce(n.url, '')))")
def j8_all(spark, sf):
    i = items(spark, sf).withColumn("content_hash", S.content_hash())
    return i.where("id % 3 = 0").join(i.where("id % 3 <> 0").select("content_hash"), "content_hash", "left_anti").select("id")


same("J8_absent_hashes", "J8_absent_hashes_all")


@query("J10_distances", "SELECT e.vec_id AS item_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q")
def j10(spark, sf):
    e = embeddings(spark, sf)
    one = rank.vector_of(e, 3)
    return e.select("item_id", F.round(S.cosine_distance(F.col("embedding"), one), 6).alias("distance"))


# Set operations

@query("U1_union", W + "SELECT id, 0 AS source_ord FROM items WHERE source = 'arxiv' UNION ALL SELECT id, 1 AS source_ord FROM items WHERE source = 'rss'")
def u1(spark, sf):
    i = items(spark, sf)
    return i.where("source = 'arxiv'").select("id", F.lit(0).alias("source_ord")).unionByName(i.where("source = 'rss'").select("id", F.lit(1).alias("source_ord")))


@query("U6_source_union", "SELECT ts::DATE AS date, list_sort(list_distinct(list_concat(list(DISTINCT event_type), ['click', 'zzz']))) AS sources FROM events GROUP BY 1")
def u6(spark, sf):
    b = briefings(spark, sf)
    return b.select("date", F.array_sort(F.array_union("sources", F.array(F.lit("click"), F.lit("zzz")))).alias("sources"))


# General regression over the star schema

@query("G1_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def g1(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("G2_top_customers", """WITH s AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT c_custkey, c_name, n_name, total, rn::INT AS rn FROM (SELECT c_custkey, c_name, n_name, round(s, 2) AS total, row_number() OVER (PARTITION BY n_name ORDER BY s DESC, c_custkey) AS rn
FROM customer JOIN s ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey) WHERE rn <= 3""")
def g2(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    c = table(spark, sf, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("s").desc(), "c_custkey")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_custkey", "c_name", "n_name", F.round("s", 2).alias("total"), "rn")


