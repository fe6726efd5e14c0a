"""The query surface and injected services."""

import json

import pytest
from pyspark.sql import functions as F

from newsweave.config import Settings
from newsweave.plans import pipeline
from newsweave.plans.api import NewsApi
from newsweave.plans.bindings import SURROGATE_KEYWORDS, embeddings, items, runs
from newsweave.plans.items_queries import briefings
from newsweave.sources import providers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def api(spark):
    i = items(spark, SF).cache()
    vectors = embeddings(spark, SF).withColumn("model", F.lit("m"))
    return NewsApi(i, "2024-01-31 00:00:00", vectors, briefings(spark, SF), runs(spark, SF), embed=lambda q: [1.0] * 64)


def test_listings(api):
    page, total = api.list_items(topic="models", limit=5)
    assert page.count() == 5 and total == api.count_items(topic="models") and "full_text" not in page.columns
    assert api.list_items(source="arxiv", limit=200)[1] == api.items.where("source = 'arxiv'").count()
    assert [r.id for r in api.latest("recent", limit=3)[0].collect()] == [r.id for r in api.items.where("ed >= '2024-01-29'").orderBy(F.col("ed").desc(), "id").limit(3).collect()]
    feed, size = api.latest(limit=5)
    assert feed.count() == 5 <= size
    assert api.top(30, 3).count() == 3 and api.trending(30)[0].where("not trending").count() == 0
    assert api.by_date("2024-01-25")[1] >= 0 and api.today()[1] >= 0


@pytest.mark.parametrize("call", [
    lambda a: a.list_items(limit=201), lambda a: a.top(limit=51), lambda a: a.trending(days=0), lambda a: a.latest(mmr_lambda=2), lambda a: a.latest("x"),
    lambda a: a.search(" "), lambda a: a.search("x", sort_by="y"), lambda a: a.daily(366), lambda a: a.daily(date_from="2024-01-01"), lambda a: a.similar(1, 21), lambda a: a.pipeline_runs(limit=501),
])
def test_bounds(api, call):
    with pytest.raises(ValueError):
        call(api)


def test_lookups(api):
    assert api.item(42).first().id == 42 and api.similar(7, 4).count() == 4
    for missing in (lambda: api.item(10**9), lambda: api.similar(10**9), lambda: api.briefing("1999-01-01")):
        with pytest.raises(KeyError):
            missing()
    record, best = api.briefing("2024-01-10")
    assert record["total_items"] > 0 and best.count() <= 20 and api.list_briefings(5)[0].count() == 5


def test_search_and_chat(api):
    page, total = api.search("the of", limit=10)
    assert page.count() == min(10, total)
    assert api.semantic("q", 5).count() == 5
    context = api.chat_context("q", 3).collect()
    assert [r.place for r in context] == [1, 2, 3] and context[0].block.startswith("[1] ") and json.loads(context[0].event.split("data: ")[1])["id"] == context[0].id
    assert api.report(api.items, F.col("id").asc(), limit=2).startswith("1. ")


def test_statistics(api):
    n = api.items.count()
    assert api.summary().first().total_items == n and sum(r["count"] for r in api.by_source().collect()) == n
    assert sum(r["count"] for r in api.daily(365).collect()) == n == sum(r["count"] for r in api.by_source_date(365).collect())
    assert api.by_topic_date(date_from="2024-01-01", date_to="2024-01-31").count() > 0 and api.trending_timeline(60).count() > 0 and api.by_topic().count() == 7
    assert api.score_distribution(60, source="reddit").count() == 6
    audit = api.audit(60)
    assert audit["totals"].first().total == n and set(audit) == {"totals", "sources", "daily", "duplicates"}
    assert {r.status for r in api.pipeline_runs("error").collect()} == {"error"} and api.freshness().count() == 8


def test_embedding_provider(spark, api):
    seen = providers.embed(api.items.select("id", "title", "summary"), lambda texts: [[float(len(t)), 1.0] for t in texts], "len", batch=7)
    assert seen.count() == 200 and seen.where("embedding[0] <= 0").count() == 0


def test_classifying_provider(spark, api):
    settings = Settings(keywords=SURROGATE_KEYWORDS)
    provider = providers.classify_with(lambda titles: 'ok [{"idx": 0, "topic": "models", "relevance": 0.99}, {"idx": 99, "topic": "models", "relevance": 1}]')
    judged = pipeline.run_classification(api.items, settings, provider).where("classifier = 'llm'")
    assert judged.count() >= 1 and judged.where("relevance_score <> 0.99 or topic <> 'models'").count() == 0


def test_retry_and_landing(spark):
    waits, answers = [], iter([(429, "", 7.0), (500, "", None), (200, "body", None)])
    assert providers.with_retry(lambda u: next(answers), sleep=waits.append)("u") == "body" and waits == [7.0, 4.0]
    with pytest.raises(OSError):
        providers.with_retry(lambda u: (404, "", None), sleep=waits.append)("u")

    def fetch(url):
        return (500, "", None) if url.endswith("bad") else (200, f"<{url}>", None)

    got = providers.land(spark, ["https://a.com/x", "http://127.0.0.1/", "https://a.com/bad"], fetch, tries=1).collect()
    assert {(r.ord, r.payload) for r in got} == {(0, "<https://a.com/x>"), (2, "")}
