"""Safe and conditional fetching, incremental embedding, stored search words."""

import pytest
from pyspark.sql import functions as F

from newsweave.operators import store
from newsweave.plans.items_queries import search
from newsweave.sources import providers


@pytest.fixture
def resolve():
    known = {"inside.org": ["10.0.0.7"], "both.org": ["93.184.216.34", "127.0.0.1"], "none.org": []}
    return lambda host: known.get(host, ["93.184.216.34"])


def test_safe_get_checks_every_hop(resolve):
    moved = {"https://a.org/1": "/2", "https://a.org/2": "http://b.org/x", "https://a.org/in": "http://inside.org/", "https://a.org/loop": "/loop"}
    asked = []

    def send(url, headers):
        asked.append(url)
        return (302, {"location": moved[url]}, []) if url in moved else (200, {}, [b"ab", b"c"])

    assert providers.safe_get(send, "https://a.org/1", resolve=resolve) == (200, {}, b"abc")
    assert asked == ["https://a.org/1", "https://a.org/2", "http://b.org/x"]
    for bad in ("ftp://a.org/", "https:///x", "http://inside.org/", "http://both.org/", "http://none.org/", "https://a.org/in", "https://a.org/loop"):
        with pytest.raises(ValueError):
            providers.safe_get(send, bad, resolve=resolve)
    assert "http://inside.org/" not in asked and asked.count("https://a.org/loop") == providers.MAX_REDIRECTS + 1
    with pytest.raises(ValueError):
        providers.safe_get(lambda u, h: (200, {}, iter([b"x" * providers.MAX_BODY, b"y"])), "https://a.org/", resolve=resolve)


def test_unchanged_feeds_are_not_read_again(spark, resolve):
    def send(url, headers):
        if url.endswith("down"):
            return 500, {}, [b"oops"]
        if headers.get("If-None-Match") == "v1" or headers.get("If-Modified-Since") == "Monday":
            return 304, {}, []
        return 200, {"etag": "v1"} if url.endswith("tag") else {"last-modified": "Monday"} if url.endswith("day") else {}, [b"<feed/>"]

    names = ["tag", "day", "plain", "down"]
    feeds = spark.createDataFrame([(k, f"https://a.org/{n}") for k, n in enumerate(names)] + [(4, "http://inside.org/x")], "ord long, url string")
    known = spark.createDataFrame([("https://other.org/", "v7", None)], "url string, etag string, last_modified string")
    first = providers.land_changed(feeds, known, send, resolve)
    assert sorted((r.ord, r.status, r.payload) for r in first.collect()) == [(0, 200, "<feed/>"), (1, 200, "<feed/>"), (2, 200, "<feed/>"), (3, 500, None), (4, -1, None)]
    known = providers.next_validators(known, first)
    assert {tuple(r) for r in known.collect()} == {("https://other.org/", "v7", None), ("https://a.org/tag", "v1", None), ("https://a.org/day", None, "Monday")}
    again = providers.land_changed(feeds, known, send, resolve)
    assert sorted((r.ord, r.status) for r in again.collect()) == [(0, 304), (1, 304), (2, 200), (3, 500), (4, -1)]
    assert {tuple(r) for r in providers.next_validators(known, again).collect()} == {tuple(r) for r in known.collect()}
    assert providers.land_changed(feeds.limit(0), known, send, resolve).count() == 0


def test_embedding_goes_on_by_model(spark):
    items = spark.createDataFrame([(k, f"title {k}", None) for k in range(7)], "id long, title string, summary string")
    stored = spark.createDataFrame([(0, "m", [1.0]), (1, "other", [1.0])], "item_id long, model string, embedding array<float>")
    service = lambda texts: [[float(len(t))] for t in texts]
    seen = []
    for _ in range(3):
        new = providers.embed_missing(items, stored, service, "m", limit=4)
        seen.append(sorted(r.item_id for r in new.collect()))
        stored = stored.unionByName(new)
    assert seen == [[1, 2, 3, 4], [5, 6], []]


def test_stored_search_words(spark):
    rows = [(0, "Neural nets", "nets and nets", "rss", None), (1, "nothing", None, "arxiv", None)]
    items = spark.createDataFrame(rows, "id long, title string, full_text string, source string, summary string").withColumn("ed", F.current_timestamp()).withColumn("score", F.lit(1))
    stored = store.with_search_vector(items)
    assert stored.where("id = 0").first().search_vector == ["neural", "nets", "nets", "and", "nets", "rss"]
    assert [tuple(r) for r in search(stored, "nets", 5).collect()] == [tuple(r) for r in search(items, "nets", 5).collect()] != []
    late = stored.withColumn("search_vector", F.when(F.col("id") == 0, F.col("search_vector")))
    assert {tuple(r.search_vector) for r in store.with_search_vector(late).collect()} == {tuple(r.search_vector) for r in stored.collect()}
