"""An inverted index for full-text search (Q13, P11, K12, K13), kept up by batches.

``path``/postings holds (term, ids, tfs), a row for a term in a stretch of items, and ``path``/docs the ids of each batch, both partitioned by batch; postings
also by ``bucket``, a hash of the term, and sorted by term inside, so a search opens the files of its
words only and skips row groups without them.  A batch is one folder: writing it again replaces
it, so a batch that is run twice changes nothing.  The latest batch of an id holds, the others' postings of
it are passed over; a deleted id has a batch without postings.  ``compact`` writes what holds as one batch.

Searches begin with the least frequent word; the postings of the others are joined onto its ids, so
they shrink word by word.  No text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import query_words
from .store import search_words

BUCKETS = 256
#: Words of a stretch of items: a task splits so many, and those of one more item, at a time.
HELD = 300_000
#: Postings that a task holds, and those of one more stretch, until it hands them on.
GATHERED = 2_000_000
#: Terms and ids hardly repeat in a bucket, so Parquet need not look for repeats.
PLAIN = {f"parquet.enable.dictionary#{column}": "false" for column in ("term", "ids.list.element")}
#: For bytes.translate: letters in lower case, a blank for ASCII that is no letter, digit or underscore; other bytes stay.
ASCII = bytes(ord(c.lower()) if c.isalnum() or c == "_" else 32 for c in map(chr, range(128))) + bytes(range(128, 256))
#: Rows of a term at most that ``compact`` writes.
STRETCHES = 1_024


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _listed(codes: pa.Array, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a code and a place below n, the different ones in order: where each code's begin and end, the places, how often each occurs."""
    keys = codes.to_numpy().astype(np.int64) * n + places
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    code, place = np.divmod(keys[starts], n)
    return np.append(0, np.cumsum(np.bincount(code))), place, np.diff(starts, append=len(keys))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, ids, tfs) of rows (id, words joined by blanks), a row for a term in a stretch of rows: words are counted
    where their row is."""
    for rows in batches:
        ends = np.cumsum(pc.count_substring(rows.column(1), " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        cuts = [0, *np.flatnonzero(np.diff((ends - 1) // HELD)) + 1, len(ends)]
        for start, end in pairwise(cuts):
            part = rows.slice(start, end - start)
            split = pc.split_pattern(part.column(1), " ")
            place = np.repeat(np.arange(len(part)), pc.list_value_length(split).to_numpy())
            words = split.flatten()
            filled = pc.not_equal(words, "")
            coded, place = words.filter(filled).dictionary_encode(), place[filled.to_numpy(zero_copy_only=False)]
            if len(place):
                bounds, places, tfs = _listed(coded.indices, place, len(part))
                lists = [part.column(0).take(pa.array(places)), pa.array(tfs, pa.int32())]
                columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values) for values in lists]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *columns], ["term", "ids", "tfs"])


def gathered(stretches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, ids, tfs) of several stretches as one, so that a term moves once for many of them."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        coded = pa.concat_arrays([b.column(0) for b in held]).dictionary_encode()
        bounds, order, _ = _listed(coded.indices, np.arange(len(coded)), len(coded))
        lists = [pa.concat_arrays([b.column(c) for b in held]).take(pa.array(order)) for c in (1, 2)]
        columns = [pa.ListArray.from_arrays(pa.array(x.offsets.to_numpy()[bounds], pa.int32()), x.values) for x in lists]
        return pa.RecordBatch.from_arrays([coded.dictionary, *columns], ["term", "ids", "tfs"])

    held, n = [], 0
    for stretch in stretches:
        held.append(stretch)
        n += len(stretch.column(1).flatten())
        if n >= GATHERED:
            yield one(held)
            held, n = [], 0
    if held:
        yield one(held)


def words_of_ascii(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (id, text) with ASCII in lower case and blanks for what parts words there; other characters stay."""
    texts = rows.column(1)
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(ASCII)) if data else None
    texts = pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data], offset=texts.offset)
    return pa.RecordBatch.from_arrays([rows.column(0), texts], ["id", "words"])


def postings(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, ids, tfs) of items; the words are those stored, or of title, full text and source.  Texts of ASCII
    alone are split without a regular expression."""
    text, words = F.concat_ws(" ", "title", "full_text", "source"), F.concat_ws(" ", search_words(items))
    stored = "search_vector" in items.columns
    given = items.select("id", (words if stored else F.when(F.octet_length(text) == F.char_length(text), text).otherwise(words)).alias("words"))
    plain = lambda batches: batches if stored else map(words_of_ascii, batches)
    found = given.mapInArrow(lambda batches: gathered(counted(plain(batches))), f"term string, ids array<{dict(items.dtypes)['id']}>, tfs array<int>")
    return found.select(bucket(F.col("term"), buckets).alias("bucket"), "term", "ids", "tfs")


def flat(found: DataFrame, *columns: str) -> DataFrame:
    """A row (term, id, tf) for each posting, with further columns."""
    return found.select("term", *columns, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"))))


def write_batch(items: DataFrame, path: str, batch: int, deleted: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Index new and changed items (one row an id) and forget deleted ids, as batch number ``batch``."""
    ids = items.select("id", F.lit(False).alias("deleted"))
    if deleted is not None:
        ids = ids.unionByName(deleted.select("id", F.lit(True).alias("deleted")).join(items.select("id"), "id", "left_anti"))
    _write(postings(items, buckets), ids, path, batch)


def _write(found: DataFrame, ids: DataFrame, path: str, batch: int) -> None:
    placed = found.repartition("bucket").sortWithinPartitions("bucket", "term")
    placed.write.mode("overwrite").options(**PLAIN).partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    ids.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")


def index_into(path: str, buckets: int = BUCKETS):
    """A foreachBatch sink: the index of a stream of items; ``deleted`` rows are forgotten."""

    def write(items: DataFrame, epoch: int) -> None:
        gone = items.where("deleted").select("id") if "deleted" in items.columns else None
        kept = items.where("not deleted") if "deleted" in items.columns else items
        write_batch(kept, path, epoch, gone, buckets)

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(id, batch) of what holds, deleted ids left out."""
    docs = spark.read.parquet(f"{path}/docs")
    last = docs.groupBy("id").agg(F.max_by("deleted", "batch").alias("deleted"), F.max("batch").alias("batch"))
    return last.where("not deleted").select("id", "batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """What holds, as batch 0 of a new index at ``to``."""
    live = latest(spark, path)
    found = flat(spark.read.parquet(f"{path}/postings"), "bucket", "batch").join(live, ["id", "batch"])
    stretch = F.pmod(F.xxhash64("id"), F.lit(STRETCHES))
    both = found.groupBy("bucket", "term", stretch.alias("s")).agg(F.collect_list(F.struct("id", "tf")).alias("l"))
    _write(both.select("bucket", "term", F.col("l.id").alias("ids"), F.col("l.tf").alias("tfs")), live.select("id", F.lit(False).alias("deleted")), to, 0)


def term_postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Postings of some words; only their buckets are opened."""
    numbers = sorted({r[0] for r in spark.range(1).select(F.explode(F.array(*[bucket(F.lit(w), buckets) for w in words]))).collect()})
    return flat(spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(numbers) & F.col("term").isin(words)), "batch")


def full_text(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, rank) of items with all words of the query: the sum of log(1 + occurrences)."""
    words = query_words(query)
    if not words:
        return spark.createDataFrame([], f"id {dict(spark.read.parquet(f'{path}/docs').dtypes)['id']}, rank double")
    found = term_postings(spark, path, words, buckets)
    frequent = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a word
    rarest, *others = sorted(words, key=lambda w: (frequent.get(w, 0), w))
    of = lambda w: found.where(F.col("term") == w).groupBy("id", "batch").agg(F.log1p(F.sum("tf")).alias(f"_{words.index(w)}"))
    ids = of(rarest).join(latest(spark, path), ["id", "batch"])
    for w in others:
        ids = ids.join(of(w), ["id", "batch"])
    total = F.col("_0")
    for k in range(1, len(words)):
        total = total + F.col(f"_{k}")
    return ids.select("id", total.alias("rank"))
