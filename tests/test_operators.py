"""Deduplication, filters, ranking, statistics and store on small tables."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.config import Settings
from newsweave.functions import titles
from newsweave.functions.udfs import similarity
from newsweave.operators import dedup, filters, rank, stats, store
from newsweave.plans.items_queries import search

def now():
    return F.lit("2025-06-15 12:00:00").cast("timestamp_ntz")
ITEM = "id long, ord long, title string, url string, source string, topic string, relevance_score double, score long, trending boolean, priority int, author string, metadata string, full_text string, composite_score double, created_at timestamp, ed timestamp"


def items(spark, *rows):
    base = dict(url=None, source="rss", topic="models", relevance_score=0.9, score=None, trending=False, priority=3, author=None, metadata="{}", full_text=None, composite_score=None, created_at=None, ed=None)
    names = [c.split(" ")[0] for c in ITEM.split(", ")]
    full = [{**base, "id": k, "ord": k, **r} for k, r in enumerate(rows)]
    out = spark.createDataFrame([tuple(r[n] for n in names) for r in full], ITEM)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "ed")})


def test_hash_dedup_golden(spark):
    i = items(spark, *[dict(title=t, url=u, score=s) for t, u, s in (("A", "a.com", 100), ("A", "a.com", 200), ("B", "b.com", 150), ("C", "b.com", 300), ("D", "d.com", 50))])
    got = dedup.hash_dedup(i)
    assert sorted((r.title, r.score) for r in got.collect()) == [("A", 100), ("C", 300), ("D", 50)]
    again = dedup.hash_dedup(got.select(i.columns))
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in got.collect())


def test_hash_dedup_without_urls_and_scores(spark):
    i = items(spark, dict(title="A"), dict(title="A"), dict(title="B", url="b"), dict(title="C", url="b"), dict(title="E", url=""))
    assert sorted(r.id for r in dedup.hash_dedup(i).collect()) == [0, 2, 4]


BASE = "OpenAI Releases GPT-5 With Major Reasoning Improvements"


def test_event_dedup(spark):
    i = items(
        spark, dict(title=BASE, score=10), dict(title=BASE + " today", score=50), dict(title=BASE + " now", score=5, priority=1), dict(title="Something else entirely"),
        dict(title=BASE, topic="tools", score=900), dict(title=BASE, topic=None),
    )
    got = {r.id: r for r in dedup.event_dedup(i).collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].source_count == 3 and got[1].trending and got[1].priority == 2 and not got[3].trending and got[4].source_count == 1
    assert dedup.event_dedup(i, Settings(event_group_limit=3)).count() == 6  # larger topics pass


@pytest.mark.parametrize("seed", [1, 2])
def test_title_pairs_lose_nothing(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "İx", "été"]
    titles = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(60)]
    i = items(spark, *[dict(title=t) for t in titles]).select("id", "title")
    got = {(r.a_id, r.b_id) for r in dedup.similar_titles(*[i.withColumn("k", F.lit(1))] * 2, ["k"]).where("a_id < b_id").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(60), 2) if similarity(titles[a], titles[b]) >= 0.8}


def test_seen_filter(spark):
    stored = items(spark, dict(title=BASE, url="x"), dict(title="An old story about databases", url="old"))
    stored = stored.withColumn("created_at", F.when(F.col("id") == 0, F.lit("2025-06-14").cast("timestamp_ntz")).otherwise(F.lit("2025-01-01").cast("timestamp_ntz")))
    new = items(spark, dict(title=BASE + " today", url="y"), dict(title="Unrelated", url="x"), dict(title="Unrelated", url="z"), dict(title="An old story about databases", url="old"), dict(title="No url"))
    by_url = dedup.unseen_by_url(new, stored, now())
    assert sorted(r.id for r in by_url.collect()) == [0, 2, 3, 4]
    assert sorted(r.id for r in dedup.unseen_by_title(by_url, stored, now()).collect()) == [2, 3, 4]




@pytest.mark.parametrize("seed", [3, 4, 5])
def test_greedy_jaccard_equals_sequential(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(14)]
    rows = [" ".join(rng.sample(pool, rng.randint(0, 9))) for _ in range(60)] + ["", ""]
    i = items(spark, *[dict(title=t) for t in rows])
    want, kept = [], []
    for k, t in enumerate(rows):
        tokens = set(t.split())
        if not any(tokens and o and len(tokens & o) / len(tokens | o) >= 0.65 for o in kept):
            kept.append(tokens)
            want.append(k)
    assert sorted(r.id for r in dedup.greedy_jaccard(i).collect()) == want


def test_greedy_chain_keeps_both_ends(spark):
    a, b, c = (" ".join(f"w{k}" for k in range(s, s + 8)) for s in (1, 2, 3))
    i = items(spark, dict(title=a), dict(title=b), dict(title=c))
    assert sorted(r.id for r in dedup.greedy_jaccard(i).collect()) == [0, 2]


def test_collapse_variants(spark):
    i = items(spark, dict(title="Qwen/Qwen3.5-0.8B", source="huggingface", score=100), dict(title="Qwen/Qwen3.5-27B", source="huggingface", score=200), dict(title="x/y", source="rss"), dict(title="plain", source="huggingface"))
    assert sorted(r.id for r in dedup.collapse_variants(i).collect()) == [1, 2, 3]


def test_mmr_golden_and_pure_quality(spark):
    i = items(
        spark, dict(title="a", source="hf", composite_score=0.9), dict(title="b", source="hf", composite_score=0.85), dict(title="c", source="hn", topic="tools", composite_score=0.7),
        dict(title="d", source="hn", topic="tools", composite_score=None),
    )
    order = lambda l: [r.id for r in rank.mmr(i, l, 4).orderBy("rank").collect()]
    assert order(0.5)[:3] == [0, 2, 1] and order(1.0) == [0, 1, 2, 3]


def test_feed_window_expands(spark):
    i = items(spark, *[dict(title=str(k), composite_score=0.5, ed=None) for k in range(5)]).withColumn("ed", F.lit("2025-06-12 13:00:00").cast("timestamp_ntz"))
    assert rank.feed_window(i, now()) == 72 and rank.feed_window(i.where("id < 4"), now()) == 168


def test_score_histogram_bounds(spark):
    i = items(spark, *[dict(title="x", score=s) for s in (-1, 0, 10, 11, 50, 51, 100, 101, 250, 251, 500, 501)])
    assert [r["count"] for r in stats.score_histogram(i).orderBy("min").collect()] == [2, 2, 2, 2, 2, 1]


def test_duplicate_groups_golden(spark):
    i = items(spark, *[dict(title="x", url=u) for u in ("a", "a", "a", "b", "b", "b", "c", None, None)])
    assert tuple(stats.duplicate_groups(i).first()) == (2, 4)


def test_day_boundaries(spark):
    t = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 23:59:59.999999"), (3, "2024-01-02 00:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [r.id for r in t.where(filters.on_day("t", "2024-01-01")).collect()] == [1, 2]
    assert [r.id for r in t.where(filters.between_days("t", "2024-01-02", None)).collect()] == [3]
    for bad in (("2024-01-01", None), (None, "2024-01-01"), ("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError):
            filters.check_range(*bad)


def test_predicates(spark):
    i = items(
        spark, dict(title=" ", url="u"), dict(title="t", url=""), dict(title="ok", url="u", source="hackernews", score=5), dict(title="l", url="u", source="hackernews", score=0, metadata='{"lane":"leading"}'),
        dict(title="low", url="u", source="reddit", score=4),
    )
    assert [r.id for r in filters.valid(i).collect()] == [2, 3, 4]
    assert [r.id for r in i.where(filters.engaged(5)).collect()] == [0, 1, 2, 3]
    assert [r.id for r in i.withColumn("credibility_score", F.when(F.col("id") == 0, 0.3).when(F.col("id") == 1, 0.29)).where(filters.credible(0.3)).collect()] == [0]
    words = F.array(F.lit("a"), F.lit("b"))
    r = spark.range(1).select(filters.matches_all(words, "A b"), filters.matches_all(words, ""), filters.newly_announced(F.lit("Announce Type: replace")), filters.newly_announced(F.lit(None).cast("string"))).first()
    assert tuple(r) == (True, False, False, True)


def test_article_links(spark):
    rows = [(0, "/a/b"), (1, "/a/b?x=1"), (2, "/a/b/"), (3, "/about/us"), (4, "/one"), (5, "https://other.com/a/b"), (6, "/news/x/y")]
    links = spark.createDataFrame([("https://e.com/news/x/y", p, h if h.startswith("http") else "https://e.com" + h) for p, h in rows], "page_url string, pos int, href string")
    assert [r.pos for r in filters.article_links(links).orderBy("pos").collect()] == [0]


def test_upsert_rules(spark, tmp_path):
    base = "url_hash string, id long, title string, score long, relevance_score double, composite_score double"
    old = spark.createDataFrame([("a", 1, "old", 10, 0.5, 0.5), ("b", 2, "keep", 10, 0.5, None), ("c", 3, "null", None, 0.5, 0.5)], base)
    new = spark.createDataFrame([("a", 9, "new", 5, 0.9, 0.1), ("b", 9, "new", 10, 0.5, 0.9), ("c", 9, "new", 7, 0.5, 0.5), ("d", 9, "fresh", 1, 0.1, 0.1)], base)
    got = {r.url_hash: r for r in store.merge_items(old, new).collect()}
    assert (got["a"].action, got["a"].title, got["a"].score, got["a"].relevance_score, got["a"].composite_score) == ("updated", "old", 10, 0.9, 0.5)
    assert got["b"].action == "unchanged" and got["c"].action == "unchanged"  # null compares as unknown
    assert got["d"].action == "inserted"
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.upsert(old) == 3 and table.upsert(new) == 2 and table.upsert(new) == 0
    assert table.read().count() == 4 and table.delete(F.col("id") == 9) == 4 and table.read().count() == 3
    table.vacuum(1)
    assert table.version() == 4 and table.truncate() == 5 and table.read().count() == 0


def test_briefing_golden(spark):
    schema = "date date, total_items long, items_extracted long, items_after_dedup long, items_filtered long, trending_count long, duration_seconds double, sources array<string>"
    d = datetime.date(2025, 6, 15)
    first = spark.createDataFrame([(d, 5, 10, 8, 5, 1, 5.5, ["rss", "arxiv"])], schema)
    run = spark.createDataFrame([(d, 3, 6, 4, 3, 0, 1.5, ["hackernews"])], schema)
    created = store.merge_briefing(first.limit(0), first)
    assert created.first().sources == ["rss", "arxiv"]
    r = store.merge_briefing(created, run).first()
    assert (r.total_items, r.items_extracted, r.trending_count, r.duration_seconds, r.sources) == (8, 6, 0, 1.5, ["arxiv", "hackernews", "rss"])


def test_insert_absent_and_cascade(spark):
    old = spark.createDataFrame([("hn", "1")], "source string, source_id string")
    new = spark.createDataFrame([("hn", "1"), ("hn", "2"), ("hn", "2")], "source string, source_id string")
    assert [tuple(r) for r in store.insert_absent(old, new, ["source", "source_id"]).collect()] == [("hn", "2")]
    assert [r.source_id for r in store.cascade(new.distinct(), old, "source_id", "source_id").collect()] == ["1"]


def test_vector_search_with_zero_vector_and_fallback(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 0.0])], "item_id long, embedding array<float>")
    q = F.array(F.lit(0.9), F.lit(0.0))
    assert [r.item_id for r in rank.nearest(v, q, 3).collect()] == [0, 1, 2]
    i = items(spark, dict(title="a"), dict(title="b"), dict(title="c", topic="tools")).withColumn("ed", F.when(F.col("id") == 0, now()).otherwise(F.lit("2020-01-01").cast("timestamp_ntz")))
    assert rank.recent_or_all(i, v, q, now(), 1).count() == 1 and rank.recent_or_all(i, v, q, now(), 2).count() == 2
    assert [r.id for r in rank.recent_or_all(i, v, q, now(), 5, topic="tools").collect()] == [2]


def test_text_search_ranks_dense_first(spark):
    i = items(spark, dict(title="sparse", full_text="neural networks once"), dict(title="dense", full_text="neural networks neural networks neural"), dict(title="neither"), dict(title="like NEURAL networkss"))
    got = [r.id for r in search(i.withColumn("summary", F.lit(None).cast("string")), "neural networks", 10).collect()]
    assert got == [1, 0, 3]


def test_lazy_choice_equals_eager_choice():
    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 150):
        facts = [(int(rng.integers(3)), int(rng.integers(4)), [None, "a", "b"][rng.integers(3)], frozenset(rng.choice(list("abcdefgh"), rng.integers(0, 5)).tolist())) for _ in range(n)]
        quality = rng.choice([0.0, 0.2, 0.5, 0.9], n).tolist()
        for lambda_ in (0.0, 0.3, 0.7, 1.0):
            left, chosen = list(range(n)), []
            while left and len(chosen) < 25:
                near = lambda i: max((rank.item_similarity(facts[i], facts[c]) for c in chosen), default=0.0)  # noqa: B023, E731
                best = max(left, key=lambda i: lambda_ * quality[i] - (1 - lambda_) * near(i))
                left.remove(best)
                chosen.append(best)
            assert rank.choose(quality, facts, lambda_, 25) == chosen


def test_bounds_of_titles_lose_nothing():
    rng = np.random.default_rng(12)
    letters = list("abcdeéß漢İ ")
    base = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(40)]
    more = []
    for t in base:
        for rate in (0.05, 0.15, 0.25):
            more.append("".join(c if rng.random() > rate else str(rng.choice(letters)) * int(rng.integers(0, 3)) for c in t))
    a, b = [*base, None, "", "İİİİ"], [*more, None, "", "i̇i̇i̇i̇"]
    for threshold in (0.5, 0.8, 0.95):
        ratio = max(0.6, threshold / (2 - threshold))
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if similarity(x, y, ratio) >= threshold}
        got = set(zip(*(x.tolist() for x in titles.candidates(titles.Titles(a), titles.Titles(b), threshold, ratio))))
        assert want <= got and len(got) < 0.5 * len(a) * len(b)
        assert titles.resembling(titles.Titles(a), titles.Titles(b), threshold, ratio).tolist() == [any(i == k for i, _ in want) for k in range(len(a))]
        side = [(x, y) for x in a for y in b]
        kept = titles.may_be_similar([x for x, _ in side], [y for _, y in side], threshold, ratio)
        assert {(k // len(b), k % len(b)) for k in np.flatnonzero(kept)} == got
