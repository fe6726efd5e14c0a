"""The index of vectors: every vector in a cell, all cells probed equal brute force, recall with few probes."""

import numpy as np

from newsweave.operators import rank, vector_index
from newsweave.plans.bindings import embeddings

SF = "/root/testdata/sf0.1"


def test_all_cells_probed_equal_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 7)
    monkeypatch.setattr(vector_index, "ASKED", 3)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(150, 6)).round(1)
    vectors[7], vectors[8] = 0, vectors[9]
    vectors[20:60] = vectors[20]  # a crowded cell
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(500, None), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)
    centres = vector_index.fit(frame, 9)
    index = vector_index.build(frame, centres)
    assert index.count() == 150 and len(centres) == 9
    queries = frame.where("item_id % 10 = 0 or item_id = 7")
    far = lambda x: 9.0 if x is None else round(x, 6)
    got = {(r.query_id, r.item_id): far(r.distance) for r in vector_index.nearest(index, queries, centres, 5, 9).collect()}
    want = {(r.query_id, r.item_id): far(r.distance) for r in rank.nearest_of_all(frame, queries, 5).collect()}
    assert got == want
    assert vector_index.nearest(index.limit(0), queries, centres, 5, 9).count() == 0
    assert len(vector_index.fit(frame.limit(0))) == 0


def test_recall_is_measured_and_reached(spark):
    """These vectors hardly cluster, so many cells are needed; clustered ones need few."""
    frame = embeddings(spark, SF).select("item_id", "embedding")
    centres = vector_index.fit(frame)
    queries = frame.where("item_id % 50 = 0")
    index = vector_index.build(frame, centres).persist()
    got = {(r.query_id, r.item_id) for r in vector_index.nearest(index, queries, centres, 10, 30).collect()}
    want = {(r.query_id, r.item_id) for r in rank.nearest_of_all(frame, queries, 10).collect()}
    assert len(got & want) >= 0.9 * len(want) == 360 and 30 < len(centres)

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in middle[k % 30] + rng.normal(size=16) * 0.05]) for k in range(1500)]
    near = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    centres = vector_index.fit(near)
    probes, recall = vector_index.probes_for(vector_index.build(near, centres), near.where("item_id % 50 = 0"), centres, 10)
    assert probes <= 4 and recall >= 0.9
