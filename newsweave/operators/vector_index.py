"""An inverted-file index of vectors (T8, T12, Q14): cells, probing, exact distances.

Coarse cells are fitted on at most ``SAMPLE`` vectors by a few rounds of spherical k-means; every vector
is then put into the cell of its nearest centre.  A query looks into the cells of its nearest centres and is
compared exactly with all vectors there.  Cells are dealt into parts of bounded size, and queries of a
cell into blocks, so a crowded cell fills many tasks, and only each part's nearest are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import cut
from .rank import _rows, nearest_of_all

SAMPLE, ROUNDS, PART, ASKED = 20_000, 8, 4096, 1024


def fit(vectors: DataFrame, cells: int | None = None, seed: int = 3) -> np.ndarray:
    """Centres of unit length, from a sample of at most ``SAMPLE`` vectors, the first by a seeded hash of the
    id; about the square root of their number, at least one."""
    chosen = vectors.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(SAMPLE)
    sample = chosen.select("embedding").toArrow()["embedding"].combine_chunks()
    unit = _rows(sample) if len(sample) else np.zeros((0, 0))
    unit = unit[np.isfinite(unit).all(axis=1)]
    if not len(unit):
        return unit
    k = min(cells or max(1, int(len(unit) ** 0.5)), len(unit))
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:k]].copy()
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _placed(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(item_id, embedding, cell) for the ``probes`` nearest cells of each vector; zero vectors are in cell 0."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    flat = vectors.select("item_id", "embedding").where("item_id is not null and embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not len(known) or not batch.num_rows:
                continue
            near = np.nan_to_num(_rows(batch.column(1)) @ known.T, nan=-9.0)
            first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(batch.num_rows), first.shape[1])
            at = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([at.column(0), at.column(1), pa.array(first.reshape(-1).astype(np.int32))], names=["item_id", "embedding", "cell"])

    kind = dict(flat.dtypes)
    return flat.mapInArrow(run, f"item_id {kind['item_id']}, embedding {kind['embedding']}, cell int")


def build(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(item_id, embedding, cell) of every vector; write it partitioned by cell to keep it."""
    return _placed(vectors, centres, 1)


def nearest(index: DataFrame, queries: DataFrame, centres: np.ndarray, limit: int, probes: int) -> DataFrame:
    """(query_id, item_id, distance): the ``limit`` nearest others of each query (item_id, embedding) in its
    ``probes`` nearest cells, ties by id; zero vectors come last."""
    asked = cut(_placed(queries, centres, probes))
    rows, several = (df.groupBy("cell").agg(F.count("*").alias("n")) for df in (index, asked))
    sizes = rows.join(several.withColumnRenamed("n", "m"), "cell").select(
        "cell", F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil(F.col("m") / ASKED).cast("int").alias("blocks")
    )
    sizes = F.broadcast(cut(sizes))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"), "item_id", "embedding")
    right = asked.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"), "item_id", "embedding")

    def compare(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "item_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        if not len(own) or not len(wanted):
            return none
        unit = lambda df: _rows(pa.array(df["embedding"].tolist(), pa.list_(pa.float64())))
        far = 1.0 - unit(wanted) @ unit(own).T
        far = np.where(np.isnan(far), 9.0, far)
        ids, who = wanted["item_id"].to_numpy(), own["item_id"].to_numpy()
        far[ids[:, None] == who[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(who, far.shape), far), axis=1)[:, :limit]
        d = np.take_along_axis(far, order, 1)
        q, k = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"query_id": ids[q], "item_id": who[order[q, k]], "distance": np.where(d[q, k] > 8, np.nan, d[q, k])})

    keys = ("cell", "part", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, item_id long, distance double")
    found = found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
    best = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item_id")
    return found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= limit).drop("_rn")


def probes_for(index: DataFrame, queries: DataFrame, centres: np.ndarray, limit: int, recall: float = 0.9) -> tuple[int, float]:
    """(probes, recall): the fewest of 1, 2, 3, 4, 6, 8, 11, ... cells with which that share of the exact nearest of
    ``queries`` is found.  Measure it on a bounded number of queries."""
    exact = cut(nearest_of_all(index, queries, limit).select("query_id", "item_id"))
    wanted, probes = exact.count(), 1
    while True:
        found = nearest(index, queries, centres, limit, probes).join(exact, ["query_id", "item_id"], "left_semi").count()
        if found >= recall * wanted or probes >= len(centres):
            return probes, found / wanted if wanted else 1.0
        probes = min(len(centres), max(probes + 1, int(probes * 1.4)))
