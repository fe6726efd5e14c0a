"""Structured Streaming: micro-batch ingestion, dedup in a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.bucketed import BucketedTable
from ..operators.store import VersionedTable


def unseen(stream: DataFrame, ts: str = "created_at", days: int = 7) -> DataFrame:
    """D2 on a stream: the first row of each url in the window; rows without url pass."""
    hashed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("url_hash", S.url_hash())
    key = F.coalesce("url_hash", F.concat(F.lit("no-url:"), S.content_hash()))
    return hashed.withColumn("_key", key).withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def upsert_into(table: VersionedTable, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink.  The upsert keeps the better scores, so a batch that is
    run again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = prepare(batch)
        if new.limit(1).count():
            table.upsert(new)

    return write


def merge_into(table: BucketedTable, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink into buckets; a batch is known by its number, so one that is run
    again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.upsert(prepare(batch), f"epoch-{epoch}")

    return write


def windowed_counts(stream: DataFrame, keys: list[str], ts: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling event-time counts with a watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("count")).select("window.start", "window.end", *keys, "count")


def resumed(months: DataFrame, last_month: str | None) -> DataFrame:
    """Months after the checkpoint."""
    return months if last_month is None else months.where(F.col("month") > last_month)


def missing_embeddings(items: DataFrame, vectors: DataFrame, limit: int = 500) -> DataFrame:
    """Items without a vector, least ids first."""
    return items.join(vectors.select(F.col("item_id").alias("id")), "id", "left_anti").orderBy("id").limit(limit)


def late_rows(stream: DataFrame, ts: Column, as_of: Column, hours: int) -> DataFrame:
    """Rows beyond the look-back, which a run would no longer read."""
    return stream.where(ts < as_of - F.make_dt_interval(hours=F.lit(hours)))
