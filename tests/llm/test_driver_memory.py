"""What the pipeline leaves to the driver: few tasks, short paths, no vocabulary, no words without weight."""

import numpy as np
import public_tokenizers
import pytest

from newsweave.llm import near_copies, packing, toxicity
from newsweave.llm.common import labelled_sample
from newsweave.llm.components import connected_components

HELD = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_few_edges_take_few_tasks(many_partitions):
    spark = many_partitions
    sc, n = spark.sparkContext, 400
    place = np.random.default_rng(1).permutation(n).tolist()
    path = spark.createDataFrame([(place[k], place[k + 1]) for k in range(n - 1)], "a long, b long")
    sc.setJobGroup("rounds", "rounds")
    try:
        found = connected_components(path)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("rounds")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tasks = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
    assert sum(s.numCompletedTasks for s in tasks if s) < 64 * len(jobs) / 2
    assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(n)}


def test_buckets_become_stars_of_their_least(spark):
    t = np.random.default_rng(2).permutation(5_200).tolist()
    large = [(7, x, x) for x in t[:5_000]]
    near = [(8, x, 12345 ^ (1 << x % 3)) for x in t[5_000:5_100]]
    alone = [(8, x, ~12345) for x in t[5_100:5_101]]
    rows = spark.createDataFrame(large + near + alone, "band long, t long, fp long")
    got = {(r.a, r.b) for r in near_copies.compare_bands(rows, 4096).collect()}
    want = {(min(own), x) for own in (t[:5_000], t[5_000:5_100]) for x in own} - {(x, x) for x in t}
    assert {e for e in got if e[0] != e[1]} == want


def test_packing_leaves_the_vocabulary_to_the_tasks(spark):
    packing.encoder.cache_clear()
    docs = spark.createDataFrame([(1, "one two three", "a"), (2, None, None)], "doc_id long, text string, source string")
    for rows, pieces in ((docs, 2), (docs.limit(0), 0)):
        assert len({r.doc_id for r in packing.pack(rows, public_tokenizers.path("word_bpe_49k.json")).collect()}) == pieces
    assert packing.encoder.cache_info().currsize == 0


def test_only_words_with_a_weight_reach_the_driver(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen, descend = [], toxicity.descend
    monkeypatch.setattr(toxicity, "descend", lambda words, *rest: (seen.append(len(words)), descend(words, *rest))[1])
    model = toxicity.fit(docs, labels)
    sample = labelled_sample(docs, labels, "toxic", 6, toxicity.SAMPLE, toxicity.MOST_BYTES, "doc_id", "text", 5, 0)
    rows = sorted(sample.collect(), key=lambda r: r.id)
    bags = [toxicity.bag(r.text.encode()) for r in rows]
    plain = toxicity.train(bags, np.array([r.label for r in rows]))
    assert (model.weights == plain.weights).all() and model.weights.any()
    assert (model.bias, model.rate, model.spread) == (plain.bias, plain.rate, plain.spread)
    assert seen[0] == seen[1] < sum(len(w) for w, _ in bags) / 2
