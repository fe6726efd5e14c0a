"""Historical scans, their checkpoint, the scheduled run and the nearest of many vectors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.operators import dedup, rank
from newsweave.plans import backfill, pipeline
from newsweave.sources.providers import with_jitter, with_retry


@pytest.fixture(scope="module")
def landed(spark):
    hit = lambda i, points, at, title="large language models of the year": {"objectID": i, "title": title, "points": points, "created_at_i": at, "url": f"https://a.org/{i}"}
    jan, feb = 1704067200, 1706745600
    pages = [
        ("2024-01", 0, {"hits": [hit("1", 90, jan + 5), hit("2", 50, jan + 6), hit("1", 95, jan + 7), hit("9", 99, jan)]}),
        ("2024-01", 1, {"hits": [hit("1", 99, jan + 8), hit("3", 51, feb)]}),
        ("2024-02", 0, {"hits": [hit("1", 70, feb + 9), hit("4", 60, feb + 1)]}),
        ("2024-02", 1, {"nbPages": 1}),
    ]
    return spark.createDataFrame([(m, o, json.dumps(p)) for m, o, p in pages], "month string, ord long, payload string")


def test_historical_stories(landed):
    got = sorted((r.month, r.source_id, r.score) for r in backfill.historical_hackernews(landed).collect())
    assert got == [("2024-01", "1", 90), ("2024-02", "1", 70), ("2024-02", "4", 60)]
    assert backfill.historical_hackernews(landed.limit(0)).count() == 0


def test_historical_repositories_and_models(spark):
    repo = lambda n, stars, at: {"full_name": n, "stargazers_count": stars, "pushed_at": at}
    github = [("2024-01", 0, json.dumps({"items": [repo("a/b", 300, "2024-01-31T23:59:59Z"), repo("a/b", 301, "2024-01-01T00:00:00Z"), repo("c", 200, "2024-01-05T00:00:00Z"), repo("d", 900, "2024-02-01T00:00:00Z"), repo("e", 900, None)]}))]
    got = backfill.historical_github(spark.createDataFrame(github, "month string, ord long, payload string")).collect()
    assert [(r.source_id, r.score) for r in got] == [("a/b", 300)]
    model = lambda i, n, at, **k: {"id": i, "downloads": n, "lastModified": at, **k}
    models = [("2024-01", 0, json.dumps([model("x", 100, "2023-01-01T00:00:00.000Z"), model("y", 99, "2024-01-01T00:00:00.000Z"), model("z", 500, "2022-12-31T00:00:00.000Z"), model("w", 500, "2024-01-01T00:00:00.000Z", modelId="org/w"), model("v", 700, None)]))]
    got = backfill.historical_huggingface(spark.createDataFrame(models, "month string, ord long, payload string")).collect()
    assert sorted((r.source_id, r.score) for r in got) == [("org/w", 500), ("x", 100)]


def test_backfill_resumes_and_skips_stored_rows(spark, landed, tmp_path):
    path = str(tmp_path / "checkpoint")
    assert backfill.load_checkpoint(None) == {}
    backfill.save_checkpoint(spark, path, {"hackernews": "2023-12"}, "2024-03-01 00:00:00")
    backfill.save_checkpoint(spark, path, {"hackernews": "2024-01", "github": "2023-11"}, "2024-03-01 00:00:01")
    done = backfill.load_checkpoint(spark.read.parquet(path))
    assert done == {"hackernews": "2024-01", "github": "2023-11"}
    stored = spark.createDataFrame([("hackernews", "4")], "source string, source_id string")
    out = backfill.backfill(spark, {"hackernews": landed}, "2024-01", "2024-02", stored, "2024-03-01 00:00:00", done=done, embed=lambda items: items.select("id"))
    assert [(r.source_id, r.month) for r in out["raw"].collect()] == [("1", "2024-02")]
    assert set(out) == {"raw", "items", "embeddings"} and out["embeddings"].count() == out["items"].count() <= 1


def test_scheduled_run_skips_open_breakers_and_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    ran = []

    def run(sources):
        ran.append(sources)
        if "bad" in sources:
            raise OSError("x" * 600)
        return spark.range(1), {"extracted": 3}

    log = None
    for k in range(4):
        pipeline.run_scheduled(spark, ["good", "bad"] if k < 3 else ["bad"], run, path, log, f"r{k}", f"2024-01-01 00:0{k}:00")
        log = spark.read.parquet(path)
    assert ran == [["good", "bad"]] * 3  # three failures open both breakers
    assert log.count() == 6 and {len(r.error_message) for r in log.collect()} == {500}
    assert pipeline.closed_sources(log, ["good", "new"], "2024-01-01 00:10:00") == ["new"]
    assert pipeline.run_scheduled(spark, ["good"], run, path, log, "r9", "2024-01-01 01:02:01").count() == 1
    assert spark.read.parquet(path).where("status = 'success'").first().counters == {"extracted": 3}


def test_prompts_number_their_items(spark):
    rows = [(k, f"t{k}", "rss", None if k == 1 else k, "x" * 300 if k else None) for k in range(12)]
    got = {r.batch: r for r in pipeline.prompts(spark.createDataFrame(rows, "ord long, title string, source string, score long, full_text string")).collect()}
    assert (got[0].n, got[1].n) == (10, 2) and "[1] title: t11\n" in got[1].prompt and "[2]" not in got[1].prompt
    assert "x" * 200 in got[0].prompt and "x" * 201 not in got[0].prompt and "source: rss | score: 0\n" in got[0].prompt


def test_jitter_waits_longer_by_its_share():
    waits = []
    replies = iter([(429, "", 5.0), (503, "", None), (200, "ok", None)])
    assert with_retry(lambda url: next(replies), sleep=with_jitter(waits.append, 0.3, lambda: 0.5))("u") == "ok"
    assert waits == [5.75, 4.6]


def test_nearest_of_all_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 5)).round(1)
    vectors[7], vectors[8] = 0, vectors[9]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(500, None), (None, [1.0] * 5)]
    frame = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)
    got = rank.nearest_of_all(frame, frame.where("item_id % 10 = 0 or item_id = 7"), 4, block=5).collect()
    unit = np.float32(vectors).astype(float)
    with np.errstate(invalid="ignore"):
        unit = unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))
    for q in [*range(0, 120, 10), 7]:
        distance = 1 - unit @ unit[q]
        want = sorted((9.0 if np.isnan(d) else round(d, 9), k) for k, d in enumerate(distance) if k != q)[:4]
        assert sorted(r.item_id for r in got if r.query_id == q) == sorted(k for _, k in want)


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    rng = np.random.default_rng(7)
    rounds = {}
    for n in (30, 500):
        names = rng.permutation(n).tolist()
        edges = spark.createDataFrame([(names[k], names[k + 1]) for k in range(n - 1)] + [(5, 5), (None, 3)], "a_id long, b_id long")
        found, rounds[n] = dedup.stars(edges)
        assert found.count() == n - 1 and found.select("centre").distinct().collect() == [(0,)]
    assert rounds[500] <= 12 and rounds[500] - rounds[30] <= 6


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 300, (200, 2)).tolist()
    root = list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[max(top(x), top(y))] = min(top(x), top(y))
    got = dedup.components(spark.createDataFrame(pairs, "a_id long, b_id long"), spark.range(300)).collect()
    assert {r.id: r.component for r in got} == {x: top(x) for x in range(300)}
    assert dedup.components(spark.createDataFrame([], "a_id long, b_id long"), spark.range(2)).count() == 2
