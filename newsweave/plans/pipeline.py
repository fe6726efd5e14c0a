"""The ingestion run (C1) and its parts (C2-C7), feed and retrieval helpers.

Stages are lazy DataFrames; each is written to the shared folder at three
points (after deduplication, after the seen filter, before the store) because
its row count is wanted anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import scalars as S
from ..operators import dedup, filters, rank, store
from ..streaming.breaker import breaker_states

Provider = Callable[[DataFrame], DataFrame]


def classify(df: DataFrame, settings: Settings = DEFAULT, text: str = "full_text") -> DataFrame:
    """adds topic, relevance, matches, gate, priority."""
    out = S.with_keyword_class(df, "title", text, settings.keywords)
    return out.withColumn("gate", S.gate(F.col("matches"))).withColumn("priority", S.priority("score", "relevance"))


def spread(df: DataFrame) -> DataFrame:
    """A checkpoint with the rows dealt by id.  Ahead of steps that are costly by row: the parts of a union or join are
    merged into few tasks by their bytes, whatever their rows then take."""
    return dedup.cut(df.repartition("id"))


def run_classification(df: DataFrame, settings: Settings = DEFAULT, provider: Provider | None = None, collapse: bool = False) -> DataFrame:
    """Accepted by keywords, the ambiguous by the provider (or keywords), then event dedup.

    collapse: also collapse model variants, which the described pipeline leaves to the feed.
    """
    marked = dedup.cut(classify(df, settings))  # the keyword patterns are the costly part
    sure = marked.where((F.col("gate") == "accept") & filters.accepted(settings.min_relevance, settings.topics))
    unsure = marked.where(F.col("gate") == "ambiguous")
    judged = (provider(unsure) if provider else unsure).where(filters.accepted(settings.min_relevance, settings.topics))
    both = sure.withColumn("classifier", F.lit("keyword")).unionByName(judged.withColumn("classifier", F.lit("llm" if provider else "keyword")))
    out = dedup.event_dedup(dedup.cut(both.drop("relevance_score").withColumnRenamed("relevance", "relevance_score")), settings)
    return dedup.collapse_variants(out).drop("family") if collapse else out


def batches(df: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """Fixed chunks in order."""
    numbered = rank.running_sum(df, order, F.lit(1), "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def model_reply(reply: Column) -> Column:
    """the JSON array of a model's reply: fences removed, else from the first [ to the last ]."""
    bare = F.trim(F.regexp_replace(reply, r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    schema = "array<struct<idx: int, topic: string, relevance: double, summary: string>>"
    return F.coalesce(F.when(bare.startswith("["), F.from_json(bare, schema)), F.from_json(inner, schema))


def join_replies(rows: DataFrame, replies: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Replies (batch, reply) by index onto rows (batch, pos); bad indexes are dropped,
    a repeated index repeats its row."""
    parsed = replies.select("batch", F.explode(model_reply(F.col("reply"))).alias("r")).select("batch", F.col("r.idx").alias("pos"), "r.topic", "r.relevance", "r.summary")
    kept = rows.drop("topic", "relevance", "summary").join(parsed, ["batch", "pos"])
    return kept.where(filters.accepted(settings.min_relevance, settings.topics))


def run_scoring(df: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    """C4."""
    return df.withColumn("composite_score", S.composite(as_of, settings))


def run_validation(df: DataFrame, settings: Settings = DEFAULT, enabled: bool = True) -> DataFrame:
    """Credibility, its filter, the engagement filter, greedy near-duplicates."""
    if not enabled:
        return df
    scored = df.withColumn("credibility_score", S.credibility(settings))
    kept = scored.where(filters.credible(settings.min_credibility)).where(filters.engaged(settings.min_social_score))
    return dedup.greedy_jaccard(kept, settings)


def run_pipeline(new: DataFrame, stored: DataFrame, as_of: Column, settings: Settings = DEFAULT, provider: Provider | None = None, count: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """C1 up to the merged table: (merged rows with action, counters A26, none of them unless ``count``)."""
    unique = spread(dedup.hash_dedup(new).drop("part", "place", "content_hash"))
    unseen = dedup.unseen_by_url(unique, stored, as_of, settings.seen_days)
    fresh = spread(dedup.unseen_by_title(unseen, stored, as_of, settings))
    valid = filters.valid(fresh)
    classified = spread(run_classification(valid, settings, provider))
    scored = run_scoring(classified, as_of, settings)
    validated = dedup.cut(run_validation(scored, settings))
    columns = [c for c in stored.columns if c != "url_hash"]
    hashed = validated.withColumn("url_hash", S.url_hash())
    for c in columns:
        if c not in hashed.columns:
            hashed = hashed.withColumn(c, F.lit(None).cast(stored.schema[c].dataType))
    base = stored.withColumn("url_hash", S.url_hash()).where("url_hash is not null")
    order = F.struct(
        F.col("composite_score").isNull(), -F.coalesce("composite_score", F.lit(0.0)), -F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id")
    )
    best = dedup.least_by(base, ["url_hash"], order)
    merged = dedup.cut(store.merge_items(best.select("url_hash", *columns), hashed.select("url_hash", *columns)))
    return merged, _counters(new, unique, fresh, classified, validated, merged) if count else {}


def _counters(new: DataFrame, unique: DataFrame, fresh: DataFrame, classified: DataFrame, validated: DataFrame, merged: DataFrame) -> dict[str, int]:
    """A26, all of them in one job."""
    every = F.count("*")
    asked = {
        "extracted": (new, every), "unique": (unique, every), "fresh": (fresh, every), "classified": (classified, every), "validated": (validated, every),
        "stored": (merged, F.count_if(F.col("action") != "unchanged")), "trending": (classified, F.count_if("trending")),
    }
    parts = [df.agg(value.alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, value) in asked.items()]
    n = {r["name"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()}  # a row a counter
    return {
        "extracted": n["extracted"], "after_dedup": n["unique"], "seen_filtered": n["unique"] - n["fresh"], "classified": n["classified"],
        "validated": n["validated"], "stored": n["stored"], "trending": n["trending"],
    }


def run_record(counters: dict[str, int], status: str = "success", error: str | None = None) -> dict:
    """K6: a row of the run log; the error text is cut at 500 characters."""
    return {**counters, "status": "empty" if status == "success" and not counters.get("extracted") else status, "error_message": error and error[:500]}


def append_record(spark: SparkSession, path: str, run_id: str, started_at: str, sources: list[str], record: dict) -> DataFrame:
    """K6: append a run to the log at ``path`` (one row a source) and return the whole log."""
    counts = {k: v for k, v in record.items() if k not in ("status", "error_message")}
    rows = [(run_id, started_at, s, record["status"], record.get("error_message"), counts) for s in sources]
    schema = "run_id string, started_at string, source string, status string, error_message string, counters map<string, long>"
    spark.createDataFrame(rows, schema).withColumn("started_at", F.col("started_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def closed_sources(log: DataFrame | None, sources: list[str], as_of: str, threshold: int = 3, reset_seconds: int = 3600) -> list[str]:
    """Sources whose breaker isn't open at ``as_of``, by the run log."""
    if log is None:
        return sources
    due = log.sparkSession.createDataFrame([(s, as_of) for s in sources], "source string, started_at string")
    due = due.select("source", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.lit("~").alias("run_id"), F.lit("due").alias("status"))
    past = log.where(F.col("started_at") < F.lit(as_of).cast("timestamp_ntz")).select("source", "started_at", "run_id", "status")
    states = breaker_states(past.unionByName(due), threshold, reset_seconds).where("status = 'due' and not open")
    found = {r.source for r in states.select("source").collect()}  # one row a source
    return [s for s in sources if s in found]


def run_scheduled(
    spark: SparkSession, sources: list[str], run: Callable[[list[str]], tuple[DataFrame, dict[str, int]]], log_path: str, log: DataFrame | None, run_id: str, as_of: str,
) -> DataFrame | None:
    """Breaker gate, run_pipeline() over the sources that pass, and a row of the log.

    ``run`` takes the sources and returns what run_pipeline() does.  A run that raises is
    logged as an error of all its sources; it doesn't end the schedule.  Without a source
    that passes nothing is run or logged.
    """
    active = closed_sources(log, sources, as_of)
    if not active:
        return None
    try:
        merged, counters = run(active)
        record = run_record(counters)
    except Exception as error:  # noqa: BLE001  whatever fails is the breaker's matter
        merged, record = None, run_record({}, "error", str(error))
    append_record(spark, log_path, run_id, as_of, active, record)
    return merged


#: F32: what stands before and after the items of a prompt; give your own for another service.
PROMPT = ("Classify the items below for a news digest. Reply with a JSON array of objects with idx, topic, relevance (0 to 1) and summary.\nTopics: {topics}\nItems:", "\n")


def prompts(df: DataFrame, settings: Settings = DEFAULT, size: int = 10, template: tuple[str, str] = PROMPT, order: str = "ord") -> DataFrame:
    """F32: (batch, n, prompt) of every ``size`` rows in order; texts are previewed by 200 characters."""
    placed = batches(df, size, order).withColumn("pos", F.row_number().over(Window.partitionBy("batch").orderBy(order)) - 1)
    preview = F.substring(F.coalesce("full_text", F.lit("")), 1, 200)
    line = F.concat(
        F.lit("\n["), "pos", F.lit("] title: "), F.coalesce("title", F.lit("")), F.lit("\n    source: "), F.coalesce("source", F.lit("")),
        F.lit(" | score: "), F.coalesce("score", F.lit(0)), F.lit("\n    text: "), preview,
    )
    lines = placed.select("batch", "pos", line.alias("line")).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    head = template[0].replace("{topics}", ", ".join(settings.topics))
    items_text = F.concat_ws("", F.transform("lines", lambda x: x.line))
    return lines.select("batch", F.size("lines").cast("long").alias("n"), F.concat(F.lit(head), items_text, F.lit(template[1])).alias("prompt"))


def context_blocks(items: DataFrame) -> DataFrame:
    """Numbered text blocks (place, block) for retrieval answers."""
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))
    block = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("place"), F.lit("] "), "title"), line("Source", F.col("source")), line("Topic", F.col("topic")),
        line("Date", F.date_format("published_at", "yyyy-MM-dd")), line("Summary", F.col("summary")), line("URL", F.col("url")),
    )
    return items.select("place", "id", block.alias("block"))


def sse(kind: str, *columns: str) -> Column:
    """A server-sent event with the columns as JSON."""
    return F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def report_lines(items: DataFrame) -> DataFrame:
    """Numbered lines with optional score, topic, summary and url."""
    head = F.concat(F.col("place"), F.lit(". "), "title", F.when(F.col("score").isNotNull(), F.concat(F.lit(" (score: "), F.col("score"), F.lit(")"))).otherwise(""))
    return items.select("place", F.concat_ws("\n", head, F.concat(F.lit("   Topic: "), "topic"), F.concat(F.lit("   "), "summary"), F.concat(F.lit("   "), "url")).alias("line"))
