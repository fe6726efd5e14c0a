"""Titles against the newest stored ones: one pass for each new title, whatever its candidates."""

import random

import numpy as np
import pytest

from newsweave.functions import titles
from newsweave.functions.udfs import common_length, similarity

RNG = random.Random(5)
WORDS = ["the", "model", "of", "a", "réseau", "İx", "漢字", "learns", "and", "new", "data"]


def made(n, words=9):
    return [" ".join(RNG.choices(WORDS, k=RNG.randint(0, words))) for _ in range(n)] + ["", None]


@pytest.mark.parametrize("most", [None, 64, 3000])
def test_common_lengths_of_many_titles_at_once(monkeypatch, most):
    if most:
        monkeypatch.setattr(titles, "MASK", most)
        monkeypatch.setattr(titles, "MASKS", 4 * most)
    b = titles.Titles(made(60) + ["x" * 300, "ab" * 120])
    for a in made(20) + ["x" * 200, "ba" * 90]:
        for chosen in (np.arange(len(b.titles)), np.array([1, 4, 5, 33])):
            want = [common_length((a or "").lower(), b.titles[j].lower()) for j in chosen]
            assert titles.common_lengths((a or "").lower(), b, chosen).tolist() == want


def test_one_pass_a_title(monkeypatch):
    passes, real = [], titles.common_lengths
    monkeypatch.setattr(titles, "common_lengths", lambda *a: (passes.append(len(a[2])), real(*a))[1])
    a, b = made(80, 12), made(300, 12)
    found = titles.resembling(titles.Titles(a), titles.Titles(b), 0.8, 0.67)
    assert found.tolist() == [any(similarity(x, y, 0.67) >= 0.8 for y in b) for x in a]
    assert len(passes) <= len(a) and sum(passes) > 3 * len(a)


def test_rows_without_url_are_dealt_over_the_partitions(spark):
    from pyspark.sql import functions as F

    from newsweave.operators import dedup

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), "id")).alias("url"), F.lit("2024-01-30").cast("timestamp_ntz").alias("created_at"))
        kept = dedup.unseen_by_url(new.coalesce(1), new.where("id % 4 = 0"), F.lit("2024-01-31").cast("timestamp_ntz"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = kept.select("id", "url", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.id for r in rows) == [k for k in range(400) if k % 4]
    assert len({r.p for r in rows if r.url is None}) == 4
