"""Backfill (C5): historical scans month by month (S13-S15), their checkpoint (K7) and phases.

Payloads are landed pages: (month, ord, payload), one JSON reply each.  Scans give raw
rows (source, source_id, raw_json, title, score, published_at, month); the first of each
id in a month counts, by page and place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scalars as S
from ..operators import dedup, store
from ..sources.payloads import month_ranges, raw_to_items
from ..streaming.jobs import resumed
from .pipeline import Provider, run_classification

RAW = ("source", "source_id", "raw_json", "title", "score", "published_at", "month")


def _elements(payloads: DataFrame, path: str | None) -> DataFrame:
    """(month, ord, pos, raw_json): the elements of each payload's array, as they are."""
    array = F.get_json_object("payload", f"$.{path}") if path else F.col("payload")
    parsed = payloads.select("month", "ord", F.from_json(array, "array<variant>").alias("e"))
    return parsed.select("month", "ord", F.posexplode("e").alias("pos", "v")).select("month", "ord", "pos", F.to_json("v").alias("raw_json"))


def _scan(rows: DataFrame, source: str, source_id: Column, title: Column, score: Column, published: Column) -> DataFrame:
    raw = rows.select(
        F.lit(source).alias("source"), source_id.alias("source_id"), "raw_json", title.alias("title"), F.coalesce(score, F.lit(0)).alias("score"),
        published.alias("published_at"), "month", "ord", "pos",
    )
    first = dedup.least_by(raw.where(F.col("source_id").isNotNull()), ["month", "source_id"], F.struct("ord", "pos"))
    return first.select(*RAW)


def _field(name: str) -> Column:
    return F.get_json_object("raw_json", f"$.{name}")


def _in_month(seconds: Column) -> Column:
    start = F.to_date(F.concat("month", F.lit("-01")))
    return (seconds >= F.unix_timestamp(start.cast("timestamp"))) & (seconds < F.unix_timestamp(F.add_months(start, 1).cast("timestamp")))


def historical_hackernews(payloads: DataFrame, min_points: int = 50) -> DataFrame:
    """Stories of a month with more than ``min_points``; strict bounds."""
    created, points = _field("created_at_i").try_cast("long"), _field("points").try_cast("long")
    start = F.unix_timestamp(F.to_date(F.concat("month", F.lit("-01"))).cast("timestamp"))
    rows = _elements(payloads, "hits").where(_in_month(created) & (created > start) & (points > min_points))
    return _scan(rows, "hackernews", _field("objectID"), _field("title"), points, F.timestamp_seconds(created))


def historical_github(payloads: DataFrame, min_stars: int = 200) -> DataFrame:
    """Repositories pushed in a month with more than ``min_stars``."""
    pushed, stars = S.parse_iso(_field("pushed_at")), _field("stargazers_count").try_cast("long")
    rows = _elements(payloads, "items").where(_in_month(F.unix_timestamp(pushed)) & (stars > min_stars))
    return _scan(rows, "github", _field("full_name"), _field("full_name"), stars, pushed)


def historical_huggingface(payloads: DataFrame, min_downloads: int = 100, since: str = "2023-01") -> DataFrame:
    """Models with ``min_downloads`` or more that changed since a month."""
    changed, downloads = S.parse_iso(_field("lastModified")), _field("downloads").try_cast("long")
    first = F.unix_timestamp(F.to_date(F.lit(f"{since}-01")).cast("timestamp"))
    rows = _elements(payloads, None).where((F.unix_timestamp(changed) >= first) & (F.coalesce(downloads, F.lit(0)) >= min_downloads))
    name = F.coalesce(F.when(_field("modelId") != "", _field("modelId")), _field("id"))
    return _scan(rows, "huggingface", name, name, downloads, changed)


SCANS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hackernews": historical_hackernews, "github": historical_github, "huggingface": historical_huggingface,
}


def save_checkpoint(spark: SparkSession, path: str, entries: dict[str, str], as_of: str) -> None:
    """K7: the last month done by source, appended as a row each; the newest counts."""
    rows = [(s, m, as_of, uuid.uuid4().hex) for s, m in entries.items()]
    spark.createDataFrame(rows, "source string, last_month string, at string, run string").coalesce(1).write.mode("append").parquet(path)


def load_checkpoint(log: DataFrame | None) -> dict[str, str]:
    """K7: last month by source, of a log that save_checkpoint() wrote (None: nothing done)."""
    if log is None:
        return {}
    newest = log.groupBy("source").agg(F.max(F.struct("at", "last_month")).alias("k"))
    return {r.source: r.last_month for r in newest.select("source", F.col("k.last_month").alias("last_month")).collect()}


def extract(spark: SparkSession, landed: dict[str, DataFrame], first: str, last: str, done: dict[str, str]) -> DataFrame:
    """Phase 1: raw rows of the months that are left (D13), each source by its scan."""
    out = None
    for source, payloads in landed.items():
        months = resumed(month_ranges(spark, first, last), done.get(source)).select("month")
        part = SCANS[source](payloads.join(F.broadcast(months), "month"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no landed source")
    return out


def backfill(
    spark: SparkSession, landed: dict[str, DataFrame], first: str, last: str, stored_raw: DataFrame, as_of: str,
    settings: Settings = DEFAULT, provider: Provider | None = None, done: dict[str, str] | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Extract, classify, embed.  Raw rows that are stored already are left out (K3, K8);
    what the phases give is returned, to be written by the caller."""
    found = extract(spark, landed, first, last, done or {})
    fresh = dedup.cut(store.insert_absent(stored_raw, found, ["source", "source_id"]))
    items = raw_to_items(fresh.withColumn("extracted_at", F.lit(as_of).cast("timestamp")))
    key = F.xxhash64("source", "url")
    prepared = items.select(
        key.alias("id"), key.alias("ord"), "title", "source", "url", F.col("text").alias("full_text"), "published_at", "score",
        F.lit(None).cast("string").alias("topic"), F.lit(None).cast("double").alias("relevance_score"), F.lit(None).cast("string").alias("summary"),
        F.lit(False).alias("trending"),
    )
    classified = dedup.cut(run_classification(prepared, settings, provider))
    out = {"raw": fresh, "items": classified}
    if embed is not None:
        out["embeddings"] = embed(classified)
    return out
