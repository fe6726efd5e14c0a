"""Injected services as DataFrame transforms, and a retrying paged reader (S17, S21, S22, X-a to X-d).

The service itself is a function given by the caller; offline tests give a stub.
"""

from __future__ import annotations

import json
import random
import socket
import time
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import prepare_text
from ..functions.udfs import is_public, safe_url
from ..streaming.jobs import missing_embeddings

MAX_CHARS, BATCH = 30_000, 100
MAX_BODY, MAX_REDIRECTS = 5 * 1024 * 1024, 5
#: (url, request headers) -> status, response headers in lower case, body in chunks; follows no redirects.
Send = Callable[[str, dict[str, str]], tuple[int, dict[str, str], Iterable[bytes]]]


def embed(items: DataFrame, service: Callable[[list[str]], list[list[float]]], model: str, batch: int = BATCH) -> DataFrame:
    """(item_id, model, embedding) of id, title, summary; texts are cut at the service's limit."""
    rows = items.select(F.col("id").alias("item_id"), F.substring(prepare_text(), 1, MAX_CHARS).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"item_id": part["item_id"], "model": model, "embedding": service(part["text"].tolist())})

    return rows.mapInPandas(run, "item_id long, model string, embedding array<float>")


def embed_missing(items: DataFrame, stored: DataFrame, service: Callable[[list[str]], list[list[float]]], model: str, limit: int = 500) -> DataFrame:
    """Vectors to append to ``stored`` (item_id, model, embedding) in this run: of the first
    ``limit`` items that have none of this model.  A run that fails appends nothing; the next one takes the same items."""
    return embed(missing_embeddings(items, stored.where(F.col("model") == model), limit), service, model)


def classify_with(service: Callable[[list[str]], str], batch: int = 10) -> Callable[[DataFrame], DataFrame]:
    """A provider for run_classification(): the service sees ``batch`` titles and replies with a
    JSON array of idx, topic, relevance; rows it doesn't mention are dropped."""


    def provider(rows: DataFrame) -> DataFrame:
        schema = rows.schema
        places = {n: schema.fieldNames().index(n) for n in ("topic", "relevance")}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch]
                    reply = service(part["title"].tolist())
                    found = json.loads(reply[reply.index("[") : reply.rindex("]") + 1]) if "[" in reply else []
                    good = [r for r in found if 0 <= r.get("idx", -1) < len(part)]
                    out = part.iloc[[r["idx"] for r in good]].copy()
                    for name in places:
                        out[name] = [r.get(name) for r in good]
                    yield out

        return rows.mapInPandas(run, schema)

    return provider


def with_jitter(sleep: Callable[[float], None] = time.sleep, share: float = 0.3, draw: Callable[[], float] = random.random) -> Callable[[float], None]:
    """Waits up to ``share`` longer, so that callers don't come back all at once."""
    return lambda seconds: sleep(seconds * (1.0 + share * draw()))


def with_retry(fetch: Callable[[str], tuple[int, str, float | None]], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """fetch gives (status, body, seconds to wait or None).  429 waits as told, 5xx 2, 4, ... seconds; then it raises."""

    def get(url: str) -> str:
        for n in range(tries):
            status, body, wait = fetch(url)
            if status < 400:
                return body
            if status != 429 and status < 500 or n == tries - 1:
                break
            sleep(wait if status == 429 and wait is not None else 2.0 * 2**n)
        raise OSError(f"{url}: status {status}")

    return get


def land(spark: SparkSession, urls: list[str], fetch: Callable[[str], tuple[int, str, float | None]], tries: int = 3) -> DataFrame:
    """Payload rows (ord, payload) of urls, one partition each; unsafe urls are skipped, and a
    source that fails gives an empty payload, so that the others go on."""
    rows = spark.createDataFrame(list(enumerate(urls)), "ord long, url string").where(safe_url("url"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = with_retry(fetch, tries)
        for pdf in frames:
            bodies = []
            for url in pdf["url"]:
                try:
                    bodies.append(get(url))
                except OSError:
                    bodies.append("")
            yield pd.DataFrame({"ord": pdf["ord"], "payload": bodies})

    return rows.repartition(max(len(urls), 1), "ord").mapInPandas(run, "ord long, payload string")


def addresses(host: str) -> list[str]:
    return [info[4][0] for info in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)]


def safe_get(send: Send, url: str, headers: dict[str, str] | None = None, resolve: Callable[[str], list[str]] = addresses) -> tuple[int, dict[str, str], bytes]:
    """Every url on the way, redirects included, must be http(s) and all its addresses public;
    ValueError otherwise, after too many redirects and for a body beyond ``MAX_BODY`` bytes."""
    for _ in range(MAX_REDIRECTS + 1):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"{url}: not an http(s) url")
        try:
            found = resolve(parts.hostname)
        except OSError as e:
            raise ValueError(f"{url}: {e}") from e
        if not found or not all(map(is_public, found)):
            raise ValueError(f"{url}: address isn't public")
        status, answer, chunks = send(url, headers or {})
        if status in (301, 302, 303, 307, 308) and answer.get("location"):
            url = urljoin(url, answer["location"])
            continue
        body = b""
        for chunk in chunks:
            body += chunk
            if len(body) > MAX_BODY:
                raise ValueError(f"{url}: body of over {MAX_BODY} bytes")
        return status, answer, body
    raise ValueError(f"{url}: too many redirects")


LANDED = "ord long, url string, status int, payload string, etag string, last_modified string"


def land_changed(feeds: DataFrame, known: DataFrame, send: Send, resolve: Callable[[str], list[str]] = addresses) -> DataFrame:
    """Feeds (ord, url) fetched with the validators of ``known`` (url, etag, last_modified).

    Rows of ``LANDED``: status 304 and no payload for a feed that hasn't changed, -1 for one
    that failed; the validators are those to send next time (the old ones if none came).
    Write the rows once, then read payloads and next_validators() from what was written.
    """
    asked = feeds.select("ord", "url").join(known.select("url", "etag", "last_modified"), "url", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for url, ord_, etag, modified in pdf[["url", "ord", "etag", "last_modified"]].itertuples(index=False):
                old = [None if pd.isna(v) else v for v in (etag, modified)]
                headers = {k: v for k, v in zip(("If-None-Match", "If-Modified-Since"), old) if v}
                try:
                    status, answer, body = safe_get(send, url, headers, resolve)
                except (OSError, ValueError):
                    status, answer, body = -1, {}, b""
                new = [answer.get("etag"), answer.get("last-modified")]
                fresh = 200 <= status < 300
                rows.append((ord_, url, status, body.decode("utf-8", "replace") if fresh else None, *(new if fresh and any(new) else old)))
            yield pd.DataFrame(rows, columns=["ord", "url", "status", "payload", "etag", "last_modified"])

    return asked.repartition("url").mapInPandas(run, LANDED)


def next_validators(known: DataFrame, landed: DataFrame) -> DataFrame:
    """``known`` brought up to date by what was landed; feeds that weren't asked stay."""
    names = ["url", "etag", "last_modified"]
    new = landed.where("etag is not null or last_modified is not null").groupBy("url").agg(F.max_by(F.struct("etag", "last_modified"), "ord").alias("v"))
    return known.select(names).join(new, "url", "left_anti").unionByName(new.select("url", "v.*"))
