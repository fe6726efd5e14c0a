"""Ordering, top-k, vector search and diversified feed."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scalars as S
from .dedup import collapse_variants, cut
from .filters import since_hours


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit in the order (ties by id), with their 1-based place."""
    top = df.orderBy(*order, F.col("id")).limit(offset + limit)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order, F.col("id"))))
    return placed.where(F.col("place") > offset)


def ranged(df: DataFrame, key: str, ranges: int = 1024) -> DataFrame:
    """Adds ``_range``: ranges of a numeric key with about as many rows each, in order."""
    cuts = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    bounds, step = F.array(*[F.lit(c) for c in cuts]), 1 << (len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])
    value = F.col(key).cast("double")
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when(((at + s) <= len(cuts)) & (F.get(bounds, at + s - 1) <= value), at + s).otherwise(at))
    return df.withColumn("_range", place)


def running_sum(df: DataFrame, key: str, value: Column, name: str, ranges: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over rows up to each, in the order of a unique numeric key.

    Ranges of the key are summed first (at most ``ranges`` rows), so no task sorts the whole table.
    """
    cut = ranged(df.withColumn("_v", value), key, ranges)
    sums = cut.groupBy("_range").agg(F.sum("_v").alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_range"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.sum("_v").over(inside)).drop("_range", "_v", "_before")


def newest() -> Column:
    return F.col("ed").desc()


def by_score() -> Column:
    return F.col("score").desc_nulls_last()


def by_composite() -> Column:
    return F.col("composite_score").desc_nulls_last()


def vector_of(vectors: DataFrame, item_id: int, embedding: str = "embedding") -> Column:
    """The vector of one item as a constant; an unknown id is a KeyError."""
    row = vectors.where(F.col("item_id") == item_id).select(embedding).first()
    if row is None:
        raise KeyError(item_id)
    return F.array(*[F.lit(float(x)) for x in row[0]])


def nearest(vectors: DataFrame, query: Column, limit: int, embedding: str = "embedding") -> DataFrame:
    """Least cosine distance; a zero vector comes last."""
    return vectors.withColumn("distance", S.cosine_distance(F.col(embedding), query)).orderBy(F.col("distance").asc_nulls_last(), "item_id").limit(limit)


def nearest_of_all(vectors: DataFrame, queries: DataFrame, limit: int, block: int = 2048) -> DataFrame:
    """T8 for many queries: (query_id, item_id, distance), the ``limit`` nearest other items
    of each row of ``queries`` (item_id, embedding), ties by id; zero vectors come last.

    Queries go out in blocks of bounded size; every task keeps its nearest of each query,
    and only these are shuffled.  Null vectors and ids are no items.
    """
    flat = vectors.select("item_id", "embedding").where(F.col("item_id").isNotNull() & F.col("embedding").isNotNull())
    asked = queries.select("item_id", "embedding").where(F.col("item_id").isNotNull() & F.col("embedding").isNotNull())
    placed = running_sum(asked, "item_id", F.lit(1), "_n").withColumn("_block", F.floor((F.col("_n") - 1) / block))
    placed = cut(placed.select("item_id", "embedding", "_block"))
    out = None
    for k in range((placed.agg(F.max("_block")).first()[0] or 0) + 1):
        part = placed.where(F.col("_block") == k).select("item_id", "embedding").toArrow()  # ``block`` rows
        ids, matrix = part["item_id"].to_numpy(), _rows(part["embedding"].combine_chunks())
        found = flat.mapInArrow(_nearest_of(ids, matrix, limit), "query_id long, item_id long, distance double")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item_id")
    return out.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= limit).drop("_rn")


def _rows(column) -> np.ndarray:
    """A list column as rows of a matrix of unit length (zero rows stay)."""
    matrix = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    size = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, size, out=np.full_like(matrix, np.nan), where=size > 0)


def _nearest_of(ids: np.ndarray, matrix: np.ndarray, limit: int):
    def run(batches):
        far = np.full((len(ids), limit), np.inf)
        who = np.full((len(ids), limit), -1, np.int64)
        for batch in batches:
            own, rows = batch.column(0).to_numpy().astype(np.int64), _rows(batch.column(1))
            for a in range(0, len(own), 1024):
                d = 1.0 - matrix @ rows[a : a + 1024].T if len(ids) else np.zeros((0, len(own[a : a + 1024])))
                d = np.where(np.isnan(d), 9.0, d)  # zero vectors after all others
                d[ids[:, None] == own[None, a : a + 1024]] = np.inf
                d = np.hstack([far, d])
                w = np.hstack([who, np.broadcast_to(own[a : a + 1024], (len(ids), len(own[a : a + 1024])))])
                order = np.lexsort((w, d), axis=1)[:, :limit]
                far, who = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
        q, k = np.nonzero(np.isfinite(far))
        distance = pa.array(far[q, k], mask=far[q, k] > 8)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q].astype(np.int64)), pa.array(who[q, k]), distance], names=["query_id", "item_id", "distance"])

    return run


def recent_or_all(items: DataFrame, vectors: DataFrame, query: Column, as_of: Column, limit: int, days: int = 30, topic: str | None = None) -> DataFrame:
    """Nearest among the last ``days``; if these are fewer than ``limit``, among all."""
    joined = items.join(vectors, items["id"] == vectors["item_id"])
    if topic:
        joined = joined.where(F.col("topic") == topic)
    recent = joined.where(F.col("ed") >= (as_of - F.make_dt_interval(days=F.lit(days))))
    return nearest(recent if recent.limit(limit).count() >= limit else joined, query, limit)


def feed_window(items: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> int:
    """The first window with enough scored rows, else the last; one pass counts all."""
    hours = [int(settings.feed_hours), *[h for h in settings.feed_windows if h > settings.feed_hours]]
    scored = F.col("composite_score").isNotNull()
    n = items.agg(*[F.count_if(scored & (F.col("ed") >= since_hours(as_of, h))).alias(f"h{h}") for h in hours]).first()
    return next((h for h in hours if n[f"h{h}"] >= settings.feed_min_items), hours[-1])


def candidates(items: DataFrame, as_of: Column, limit: int, offset: int = 0, settings: Settings = DEFAULT, live: bool = True) -> DataFrame:
    """The pool by stored composite, then the live composite and one row a model family."""
    h = feed_window(items, as_of, settings)
    pool = items.where(F.col("composite_score").isNotNull() & (F.col("ed") >= since_hours(as_of, h)))
    pool = pool.orderBy(by_composite(), newest(), "id").limit(limit * settings.candidate_multiplier + offset)
    if live:
        pool = pool.withColumn("stored_score", F.col("composite_score")).withColumn("composite_score", S.composite(as_of, settings))
    return collapse_variants(pool)


def item_similarity(a: tuple, b: tuple) -> float:
    """Of (source, topic, author, title words): .3 source, .3 topic, .2 author, .2 Jaccard of titles."""
    same = 0.3 * (a[0] == b[0]) + 0.3 * (a[1] == b[1])
    if a[2] and a[2] == b[2]:
        same += 0.2
    if a[3] and b[3]:
        same += len(a[3] & b[3]) / len(a[3] | b[3]) * 0.2
    return same


def choose(quality: list[float], facts: list[tuple], lambda_: float, limit: int) -> list[int]:
    """Greedy maximal marginal relevance: places of the chosen, in order; ties go to the first.

    Closeness to the chosen only grows, so a value found earlier bounds the present one from above:
    only candidates that come up first are brought up to date.
    """
    closest, known, chosen = [0.0] * len(quality), [0] * len(quality), []
    heap = [(-(lambda_ * q - (1 - lambda_) * 0.0), i) for i, q in enumerate(quality)]
    heapq.heapify(heap)
    while heap and len(chosen) < limit:
        value, i = heapq.heappop(heap)
        if known[i] == len(chosen):
            chosen.append(i)
            continue
        for c in chosen[known[i] :]:
            closest[i] = max(closest[i], item_similarity(facts[i], facts[c]))
        known[i] = len(chosen)
        heapq.heappush(heap, (-(lambda_ * quality[i] - (1 - lambda_) * closest[i]), i))
    return chosen


def mmr(pool: DataFrame, lambda_: float = DEFAULT.mmr_lambda, limit: int = 20, by: str | None = None) -> DataFrame:
    """Greedy maximal marginal relevance over a bounded pool (its limit is part of the
    semantics); adds ``rank`` from 1.  Candidates come by stored order, ties go to the first.
    ``by`` names a column of requests, each with a pool of its own, which are served in parallel."""
    keyed = pool.withColumn("_words", S.tokens("title")).withColumn("_pool", F.col(by) if by else F.lit(0))

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        score = rows["stored_score"] if "stored_score" in rows else rows["composite_score"]
        rows = rows.assign(_s=score).sort_values(["_s", "ed", "id"], ascending=[False, False, True], na_position="last", ignore_index=True)
        none = lambda x: None if pd.isna(x) else x
        facts = [(none(s), none(t), none(a), frozenset(w)) for s, t, a, w in zip(rows["source"], rows["topic"], rows["author"], rows["_words"])]
        chosen = choose(rows["composite_score"].fillna(0.0).tolist(), facts, lambda_, limit)
        out = rows.iloc[chosen].drop(columns=["_s", "_words", "_pool"])
        out["rank"] = range(1, len(chosen) + 1)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields)
    return keyed.groupBy("_pool").applyInPandas(serve, f"{schema}, rank int")


def feed(items: DataFrame, as_of: Column, limit: int = 20, offset: int = 0, lambda_: float | None = None, settings: Settings = DEFAULT) -> tuple[DataFrame, int]:
    """Q7: (page, total); total is the pool after collapse.  A page ends at ``most_ranked`` ranks at the latest."""
    if offset + limit > settings.most_ranked:
        raise ValueError(f"no more than {settings.most_ranked} ranks")
    pool = candidates(items, as_of, limit, offset, settings)
    ranked = mmr(pool, settings.mmr_lambda if lambda_ is None else lambda_, limit + offset)
    return ranked.where(F.col("rank") > offset), pool.count()


def text_rank(words: Column, query_words: list[str]) -> Column:
    """Sum over query words of log(1 + occurrences); 0 unless all occur."""
    n = [F.size(words) - F.size(F.array_remove(words, q)) for q in query_words]
    if not n:
        return F.lit(0.0)
    present = n[0] > 0
    total = F.log1p(n[0])
    for k in n[1:]:
        present, total = present & (k > 0), total + F.log1p(k)
    return F.when(present, total).otherwise(0.0)


