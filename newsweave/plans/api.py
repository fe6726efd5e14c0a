"""The query surface as one object: listings, search, statistics, audit, chat context.

Methods take the parameters of the HTTP routes, check the same bounds and give
DataFrames; a listing also gives the total count.  ``as_of`` stands for now.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, TOPICS, Settings
from ..operators import filters, rank, stats, store
from .pipeline import context_blocks, report_lines, sse

RESPONSE = (
    "id", "title", "summary", "url", "source", "topic", "relevance_score", "dev_value_score", "credibility_score", "priority", "trending",
    "published_at", "created_at", "author", "score", "composite_score",
)


def bounded(name: str, value: int | float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low:g} and {high:g}")


@dataclass
class NewsApi:
    """items with ed (effective date); vectors (item_id, model, embedding); briefings by date; runs.

    embed: text to vector, for semantic search and chat.
    """

    items: DataFrame
    as_of: str
    vectors: DataFrame | None = None
    briefings: DataFrame | None = None
    runs: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    settings: Settings = DEFAULT

    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")

    def _respond(self, df: DataFrame) -> DataFrame:
        return df.select(*[c for c in RESPONSE if c in df.columns])

    def _filtered(self, source=None, topic=None, trending=None, date_from=None, date_to=None) -> DataFrame:
        return filters.where_given(self.items, trending, source=source, topic=topic).where(filters.between_days("ed", date_from, date_to))

    def _listing(self, df: DataFrame, *order: Column, limit: int, offset: int, most: int) -> tuple[DataFrame, int]:
        bounded("limit", limit, 1, most)
        bounded("offset", offset, 0, float("inf"))
        return self._respond(rank.page(df, *order, limit=limit, offset=offset)), df.count()

    # items

    def list_items(self, source=None, topic=None, trending=None, date_from=None, date_to=None, limit=50, offset=0):
        return self._listing(self._filtered(source, topic, trending, date_from, date_to), rank.newest(), limit=limit, offset=offset, most=200)

    def count_items(self, source=None, topic=None, date_from=None, date_to=None) -> int:
        return self._filtered(source, topic, None, date_from, date_to).count()

    def by_date(self, day: str, limit=50, offset=0):
        return self._listing(self.items.where(filters.on_day("ed", day)), rank.by_score(), rank.newest(), limit=limit, offset=offset, most=200)

    def trending(self, days=7, limit=20, offset=0):
        bounded("days", days, 1, 3650)
        recent = self.items.where(F.col("trending") & (F.col("ed") >= filters.since_days(self.now(), days)))
        return self._listing(recent, rank.by_score(), rank.newest(), limit=limit, offset=offset, most=100)

    def today(self, limit=50, offset=0):
        return self._listing(self.items.where(filters.on_day("ed", self.as_of[:10])), rank.newest(), limit=limit, offset=offset, most=200)

    def top(self, days=7, limit=10) -> DataFrame:
        bounded("days", days, 1, 3650)
        bounded("limit", limit, 1, 50)
        kept = self.items.where(F.col("composite_score").isNotNull() & (F.col("ed") >= filters.since_days(self.now(), days)))
        return self._respond(rank.page(kept, rank.by_composite(), limit=limit))

    def latest(self, sort="relevance", mmr_lambda=None, limit=20, offset=0):
        """The diversified feed, or the newest of 48 hours."""
        bounded("limit", limit, 1, 200)
        if sort == "recent":
            recent = self.items.where(F.col("ed") >= filters.since_hours(self.now(), int(self.settings.feed_hours)))
            return self._listing(recent, rank.newest(), limit=limit, offset=offset, most=200)
        if sort != "relevance":
            raise ValueError("sort must be relevance or recent")
        if mmr_lambda is not None:
            bounded("mmr_lambda", mmr_lambda, 0, 1)
        page, total = rank.feed(self.items, self.now(), limit, offset, mmr_lambda, self.settings)
        return self._respond(page.orderBy("rank")), total

    def item(self, id_: int) -> DataFrame:
        found = self.items.where(F.col("id") == id_)
        if not found.limit(1).count():
            raise KeyError(id_)
        return self._respond(found)

    def similar(self, id_: int, limit=5, model: str | None = None) -> DataFrame:
        bounded("limit", limit, 1, 20)
        vectors = self._vectors(model)
        others = self.items.join(vectors.where(F.col("item_id") != id_), F.col("id") == F.col("item_id"))
        return self._respond(rank.nearest(others, rank.vector_of(vectors, id_), limit))

    def _vectors(self, model: str | None) -> DataFrame:
        if self.vectors is None:
            raise ValueError("no vectors are given")
        return self.vectors.where(F.col("model") == model) if model else self.vectors

    # search and chat

    def search(self, q: str, topic=None, source=None, date_from=None, date_to=None, sort_by="relevance", limit=50, offset=0):
        if not q.strip():
            raise ValueError("q is empty")
        words = store.search_words(self.items)
        ranked = self._filtered(source, topic, None, date_from, date_to).withColumn("_words", words)
        ranked = ranked.withColumn("rank", rank.text_rank(F.col("_words"), filters.query_words(q)))
        kept = ranked.where(filters.matches_all(F.col("_words"), q) | filters.contains_any(q, "title", "source", "summary")).drop("_words")
        order = {"relevance": F.col("rank").desc(), "date": rank.newest(), "score": rank.by_score()}
        if sort_by not in order:
            raise ValueError(f"sort_by must be one of {', '.join(order)}")
        return self._listing(kept, order[sort_by], limit=limit, offset=offset, most=200)

    def semantic(self, q: str, limit=10, topic: str | None = None) -> DataFrame:
        bounded("limit", limit, 1, 50)
        if self.embed is None:
            raise ValueError("no embedding function is given")
        vector = F.array(*[F.lit(float(x)) for x in self.embed(q)])
        return rank.recent_or_all(self.items, self._vectors(None), vector, self.now(), limit, topic=topic)

    def chat_context(self, question: str, limit=5) -> DataFrame:
        """Numbered context blocks for an answer, with their sources as an event each."""
        found = self.semantic(question, limit).withColumn("_d", F.col("distance"))
        placed = rank.page(found, F.col("_d").asc_nulls_last(), limit=limit)
        return context_blocks(placed).join(placed.select("id", sse("source", "id", "title", "url", "topic").alias("event")), "id").orderBy("place")

    def report(self, df: DataFrame, *order: Column, limit=20) -> str:
        """Numbered text lines of a listing."""
        return "\n".join(r["line"] for r in report_lines(rank.page(df, *order, limit=limit)).orderBy("place").collect())

    # briefings and constants

    def briefing(self, day: str) -> tuple[dict | None, DataFrame]:
        """The day's record (None if there is none) and its best items; a day without both is a KeyError."""
        record = self.briefings.where(F.col("date") == F.lit(day).cast("date")).first() if self.briefings is not None else None
        rows = self.items.where(filters.on_day("ed", day))
        if record is None and not rows.limit(1).count():
            raise KeyError(day)
        return record.asDict() if record else None, self._respond(rank.page(rows, rank.by_score(), limit=20))

    def list_briefings(self, limit=30, offset=0) -> tuple[DataFrame, int]:
        return self.briefings.orderBy(F.col("date").desc()).offset(offset).limit(limit), self.briefings.count()

    def topics(self) -> tuple[str, ...]:
        return TOPICS

    # statistics

    def _window(self, days: int, date_from: str | None, date_to: str | None) -> DataFrame:
        given = filters.check_range(date_from, date_to)
        if given:
            return self.items.where(filters.between_days("ed", *given))
        bounded("days", days, 1, 365)
        return self.items.where(F.col("ed") >= filters.since_days(self.now(), days))

    def summary(self) -> DataFrame:
        return stats.summary(self.items, self.as_of[:10])

    def by_source(self) -> DataFrame:
        return stats.count_by(self.items, "source").orderBy(F.col("count").desc(), "source")

    def by_topic(self) -> DataFrame:
        return stats.count_by(self.items.where("topic is not null"), "topic").orderBy(F.col("count").desc(), "topic")

    def daily(self, days=30, date_from=None, date_to=None) -> DataFrame:
        return stats.by_date(self._window(days, date_from, date_to)).orderBy(F.col("date").desc())

    def by_topic_date(self, days=30, date_from=None, date_to=None) -> DataFrame:
        return stats.by_date(self._window(days, date_from, date_to).where("topic is not null"), "topic").orderBy("date", "topic")

    def by_source_date(self, days=30) -> DataFrame:
        return stats.by_date(self._window(days, None, None), "source").orderBy("date", "source")

    def trending_timeline(self, days=30) -> DataFrame:
        return stats.by_date(self._window(days, None, None).where("trending")).orderBy("date")

    def score_distribution(self, days=30, source=None, topic=None) -> DataFrame:
        kept = filters.where_given(self._window(days, None, None), source=source, topic=topic)
        return stats.score_histogram(kept.where("score is not null")).orderBy("min")

    # administration

    def audit(self, days=30) -> dict[str, DataFrame]:
        bounded("days", days, 1, 365)
        since = self.items.where(F.col("created_at") >= self.now() - F.make_dt_interval(days=F.lit(days)))
        return {
            "totals": stats.audit_totals(self.items), "sources": stats.audit_sources(self.items).orderBy(F.col("count").desc(), "source"),
            "daily": stats.by_date(since, "source", ts="created_at").orderBy(F.col("date").desc(), F.col("count").desc(), "source"),
            "duplicates": stats.duplicate_groups(self.items),
        }

    def pipeline_runs(self, status: str | None = None, limit=50) -> DataFrame:
        bounded("limit", limit, 1, 500)
        counters = [c for c in self.runs.columns if c.startswith("items_")]
        kept = filters.where_given(self.runs, status=status)
        return kept.orderBy(F.col("started_at").desc(), "run_id").limit(limit).withColumns({c: F.coalesce(c, F.lit(0)) for c in counters})

    def freshness(self) -> DataFrame:
        return stats.source_freshness(self.items, self.now()).orderBy("source")
