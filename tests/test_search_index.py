"""The inverted index against scans, through inserts, changes, deletes, repeated batches and a stream."""

import random

from pyspark.sql import functions as F

from newsweave.operators import filters, rank, search_index, store

WORDS = ["alpha", "beta", "Gamma", "delta", "été", "x1", "rare"]


def made(spark, rng, ids):
    rows = [(i, " ".join(rng.choices(WORDS, [9, 7, 5, 3, 2, 1, 0.3], k=rng.randint(0, 12))), rng.choice(["rss", "beta"])) for i in ids]
    return spark.createDataFrame(rows, "id long, full_text string, source string").withColumn("title", F.lit(None).cast("string"))


def scanned(items, query):
    words = store.search_vector()
    found = items.where(filters.matches_all(words, query)).select("id", rank.text_rank(words, filters.query_words(query)).alias("rank"))
    return {r.id: round(r["rank"], 9) for r in found.collect()}


def check(spark, path, items):
    for query in ("alpha", "beta gamma", "ALPHA rss", "rare delta été", "nowhere", "alpha nowhere", "", "gamma, beta! alpha delta"):
        got = {r.id: round(r["rank"], 9) for r in search_index.full_text(spark, path, query, 8).collect()}
        assert got == scanned(items, query), query


def test_index_equals_scan_through_its_life(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "index")
    first = made(spark, rng, range(120))
    search_index.write_batch(first, path, 0, buckets=8)
    check(spark, path, first)
    changed, gone = made(spark, rng, [*range(100, 130)]), spark.createDataFrame([(i,) for i in range(0, 130, 7)], "id long")
    for _ in range(2):  # a batch that is run again changes nothing
        search_index.write_batch(changed, path, 1, gone, buckets=8)
    now = first.where("id < 100").join(gone, "id", "left_anti").unionByName(changed)  # a row that is changed and deleted at once stays
    check(spark, path, now)
    search_index.compact(spark, path, str(tmp_path / "compact"))
    check(spark, str(tmp_path / "compact"), now)


def test_only_buckets_of_the_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.write_batch(made(spark, random.Random(2), range(50)), path, 0, buckets=8)
    plan = search_index.term_postings(spark, path, ["alpha"], 8)._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(term,alpha)" in plan


def test_stream_keeps_the_index_up(spark, tmp_path):
    rng, path, landed = random.Random(3), str(tmp_path / "index"), str(tmp_path / "landed")
    first, second = made(spark, rng, range(40)), made(spark, rng, range(30, 50))
    marked = second.withColumn("deleted", F.col("id") % 10 == 0)
    for some in (first.withColumn("deleted", F.lit(False)), marked):
        some.coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(marked.schema).parquet(landed)
        run = stream.writeStream.foreachBatch(search_index.index_into(path, 8)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    check(spark, path, first.where("id < 30").unionByName(second.where("id % 10 <> 0")).where("id not in (30, 40)"))
