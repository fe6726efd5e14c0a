"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCORE_BUCKETS
from ..functions.scalars import freshness, seconds_between
from .filters import on_day
from .rank import running_sum


def summary(items: DataFrame, today: str) -> DataFrame:
    """A1: totals, distinct sources and topics, and today's counts, in one pass."""
    now = on_day("ed", today)
    return items.agg(
        F.count("*").alias("total_items"), F.count_if(now).alias("items_today"), F.countDistinct("source").alias("sources"),
        F.countDistinct("topic").alias("topics"), F.count_if(F.col("trending") & now).alias("trending_today"),
    )


def count_by(items: DataFrame, *keys: str | Column) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("count"))


def by_date(items: DataFrame, *keys: str, ts: str = "ed") -> DataFrame:
    return count_by(items, F.to_date(ts).alias("date"), *keys)


def score_histogram(items: DataFrame, score: str = "score") -> DataFrame:
    """Six conditional counts in one row, then a row for each bucket; an open end is shown as 999999."""
    s = F.col(score)
    one = items.agg(*[
        F.count_if((s >= low) & (s <= high) if high is not None else s >= low).alias(name) for name, low, high in SCORE_BUCKETS
    ])
    rows = F.array(*[
        F.struct(F.lit(n).alias("range"), F.lit(low).alias("min"), F.lit(999999 if high is None else high).alias("max"), F.col(f"`{n}`").alias("count"))
        for n, low, high in SCORE_BUCKETS
    ])
    return one.select(F.inline(rows))


def audit_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def audit_sources(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("count"), F.max("created_at").alias("latest"))


def duplicate_groups(items: DataFrame, key: str = "url") -> DataFrame:
    """How many values occur more than once, and the rows beyond the first of each."""
    groups = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def source_freshness(items: DataFrame, as_of: Column) -> DataFrame:
    """A14 and P30."""
    latest = items.groupBy("source").agg(F.max("created_at").alias("latest"))
    hours = F.bround(seconds_between(as_of, F.col("latest")) / 3600, 1)
    return latest.withColumn("hours", hours).withColumn("status", freshness(F.col("hours")))


def score_distribution(items: DataFrame, value: str = "composite_score") -> DataFrame:
    """A12."""
    return items.groupBy("source").agg(
        F.count(value).alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def source_date_pivot(items: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Dates by sources, missing as 0; naming the sources saves a pass."""
    return by_date(items, "source").groupBy("date").pivot("source", list(sources)).agg(F.sum("count")).na.fill(0)


def shares(counts: DataFrame, value: str = "count") -> DataFrame:
    """Share of the total in percent, one decimal."""
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn("share", F.round(F.col(value) / total * 100, 1))


def calendar_levels(daily: DataFrame, value: str = "count") -> DataFrame:
    """Level 0 to 4 of each day against the busiest one."""
    r = F.col(value) / daily.agg(F.max(value)).scalar()
    level = F.when(F.col(value) == 0, 0).when(r <= 0.25, 1).when(r <= 0.5, 2).when(r <= 0.75, 3).otherwise(4)
    return daily.withColumn("level", level)


def day_summary(items: DataFrame, day: str) -> DataFrame:
    """Items of a day and its number of topics, uncategorised ones as one."""
    topic = F.coalesce("topic", F.lit("uncategorized"))
    return items.where(on_day("ed", day)).agg(F.count("*").alias("items"), F.countDistinct(topic).alias("topics"))


def running_cost(batches: DataFrame, order: str, budget: float, per_in: float = 0.20, per_out: float = 2.00) -> DataFrame:
    """Cumulative cost of batches (tokens_in, tokens_out) in order; a batch runs
    while the cost before it is below the budget."""
    cost = F.col("tokens_in") * per_in / 1e6 + F.col("tokens_out") * per_out / 1e6
    total = running_sum(batches.withColumn("cost", cost), order, F.col("cost"), "total")
    state = F.when(F.col("total") >= budget, "stop").when(F.col("total") >= 0.8 * budget, "warn").otherwise("ok")
    return total.withColumn("runs", (F.col("total") - F.col("cost")) < budget).withColumn("state", state)


def rate_limited(requests: DataFrame, limit: int, key: str = "user_id", ts: str = "ts", window: str = "1 minute") -> DataFrame:
    """Fixed windows with more than ``limit`` requests."""
    w = F.window(F.col(ts).cast("timestamp"), window)
    return requests.groupBy(key, w).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key, F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
