"""The whole run deals rows evenly ahead of costly steps and moves no texts that it doesn't look at."""

import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsweave.plans import ops_queries, pipeline
from newsweave.plans.bindings import at, items

SF = "/root/testdata/sf0.001"


def test_rows_of_one_partition_are_dealt_evenly(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1")
    try:
        held = Counter(r[0] for r in pipeline.spread(spark.range(400).coalesce(1)).select(F.spark_partition_id()).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert sum(held.values()) == 400 and max(held.values()) < 200


def test_the_query_moves_fronts_of_texts(spark, monkeypatch):
    seen, real = [], pipeline.run_pipeline
    monkeypatch.setattr(pipeline, "run_pipeline", lambda new, stored, *a, **k: (seen.extend((new, stored)), real(new, stored, *a, **k))[1])
    entry.queries()["C1_pipeline"](spark, SF)
    new, stored = seen
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"substring\(text#\d+, 1, 500\) AS", plan[plan.rindex("LeftOuter") :]) and "full_text" not in stored.columns


def test_rows_and_texts_are_those_of_a_run_over_whole_texts(spark):
    i = items(spark, SF)
    merged, _ = pipeline.run_pipeline(i.where("id % 2 = 0"), i.where("id % 2 = 1"), at(), ops_queries.SURROGATE, count=False)
    names = ["url_hash", "id", "title", "topic", "composite_score", "action"]
    got = sorted(map(str, entry.queries()["C1_pipeline"](spark, SF).select(names).collect()))
    assert got == sorted(map(str, merged.select(names).collect()))
    assert merged.join(i.select("id", F.col("full_text").alias("t")), "id").where("not full_text <=> t").count() == 0
