"""Pipeline composites, streaming jobs and the registered queries against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from newsweave.config import Settings
from newsweave.operators.store import VersionedTable
from newsweave.plans import items_queries, more_queries, ops_queries, pipeline  # noqa: F401
from newsweave.plans.bindings import SURROGATE_KEYWORDS, at, items, table
from newsweave.plans.registry import QUERIES, SQL
from newsweave.streaming import jobs

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    found = oracle.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"C1_pipeline"}))
def test_other_queries_give_the_same_rows_again(spark, name):
    first, again = (sorted(map(str, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_pipeline_counters_and_second_run(spark):
    i = items(spark, SF)
    settings = Settings(keywords=SURROGATE_KEYWORDS)
    stored = i.where("id % 2 = 1")
    merged, counters = pipeline.run_pipeline(i.where("id % 2 = 0"), stored, at(), settings)
    assert counters["extracted"] == 100 and counters["after_dedup"] >= counters["classified"] >= counters["validated"] >= counters["stored"] >= 0
    again, second = pipeline.run_pipeline(i.where("id % 2 = 0"), merged.drop("action", "url_hash").select(*stored.columns), at(), settings)
    assert second["stored"] <= counters["stored"] and again.count() >= merged.count()


def test_model_replies(spark):
    replies = spark.createDataFrame([(0, 'x ```json\n[{"idx":1,"topic":"models","relevance":0.9},{"idx":7,"topic":"models","relevance":0.9},{"idx":1,"topic":"tools","relevance":0.8},{"idx":0,"topic":"none","relevance":1}]```'), (1, "junk")], "batch int, reply string")
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "batch int, pos int, title string").withColumns({"topic": F.lit(""), "relevance": F.lit(0.0), "summary": F.lit("")})
    got = pipeline.join_replies(rows, replies).collect()
    assert sorted((r.title, r.topic) for r in got) == [("b", "models"), ("b", "tools")]


def test_run_record():
    assert pipeline.run_record({"extracted": 0})["status"] == "empty" and len(pipeline.run_record({}, "error", "x" * 900)["error_message"]) == 500


def test_stream_upsert_and_dedup(spark, tmp_path):
    cols = "url_hash string, id long, title string, score long, relevance_score double, composite_score double"
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x", 1, 0.5, 0.5), ("b", 2, "y", 2, 0.5, 0.5)], cols).coalesce(1).write.parquet(folder)
    target = VersionedTable(spark, str(tmp_path / "t"))

    def run():
        q = spark.readStream.schema(cols).parquet(folder).writeStream.foreachBatch(jobs.upsert_into(target)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    spark.createDataFrame([("a", 1, "x", 9, 0.5, 0.5), ("c", 3, "z", 2, 0.5, 0.5)], cols).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert sorted((r.url_hash, r.score) for r in target.read().collect()) == [("a", 9), ("b", 2), ("c", 2)]

    rows = "title string, url string, created_at timestamp"
    spark.createDataFrame([("t", "u", "2024-01-01"), ("t2", "u", "2024-01-02"), ("t", None, "2024-01-02"), ("v", None, "2024-01-02")], "title string, url string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "d"))
    q = jobs.unseen(spark.readStream.schema(rows).parquet(str(tmp_path / "d"))).writeStream.format("memory").queryName("unseen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("unseen").count() == 3


def test_stream_counts_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = jobs.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), ["event_type"], size="1 day", late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.to_date("ts"), "event_type").count()
    assert sorted(spark.table("daily").select(F.to_date("start"), "event_type", "count").collect()) == sorted(want.collect())
