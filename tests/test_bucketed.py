"""Merging batches into buckets: equal to one merge, untouched files stay, batches that are run again."""

from pathlib import Path

from pyspark.sql import functions as F

from newsweave.functions import scalars as S
from newsweave.operators import dedup, store
from newsweave.operators.bucketed import BucketedTable
from newsweave.plans.bindings import items
from newsweave.streaming import jobs

SF = "/root/testdata/sf0.001"
NAMES = ["id", "title", "source", "topic", "score", "relevance_score", "composite_score", "url_hash"]


def rows_of(spark, keep):
    i = items(spark, SF).where("url is not null").where(keep).withColumn("url_hash", S.url_hash()).select(*NAMES)
    return dedup.least_by(i, ["url_hash"], F.struct(-F.coalesce("score", F.lit(0)), F.xxhash64(*NAMES)))


def content(df):
    return sorted(map(str, df.select(*NAMES).collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet")}


def test_batches_equal_one_merge_and_untouched_buckets_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, digits=1)
    first, second = rows_of(spark, "id % 3 <> 0"), rows_of(spark, "id % 2 = 0")
    assert {r.action for r in table.upsert(first, "a").select("action").collect()} == {"inserted"}
    assert content(table.read()) == content(first)
    one = second.where(F.substring("url_hash", 1, 1).isin("3", "a"))
    before = files(path)
    table.upsert(one, "b")
    after = files(path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert changed and changed <= {"3", "10"} and all(after[f] == t for f, t in before.items() if f in after)
    want = store.merge_items(first, one)
    assert content(table.read()) == content(want)
    again = files(path)
    assert table.upsert(second, "b") is None and files(path) == again  # known by its id
    table.upsert(one)  # half done and run again: the same rows
    assert content(table.read()) == content(want)
    table.upsert(second, "c")
    assert content(table.read()) == content(store.merge_items(want.drop("action"), second))
    assert table.upsert(second.limit(0), "d") is None and table.done("d")


def test_stream_of_batches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), digits=1)
    landed = str(tmp_path / "landed")
    for k in range(2):
        rows_of(spark, f"id % 2 = {k}").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows_of(spark, "false").schema).parquet(landed)
        sink = stream.writeStream.foreachBatch(jobs.merge_into(table)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        sink.awaitTermination(120)
    assert content(table.read()) == content(store.merge_items(rows_of(spark, "id % 2 = 0"), rows_of(spark, "id % 2 = 1")))
