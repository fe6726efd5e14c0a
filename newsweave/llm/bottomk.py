"""Document fingerprints (operator 3): bottom-k sketches of shingle hashes.

A sketch holds the ``k`` least distinct 64-bit hashes of a text's shingles (five
words, or the whole sequence if it has fewer) and, below k, all of them; it is a
base64 string of big-endian hashes.  Sketches merge by keeping the k least of
both.  From two sketches come the resemblance (share of the k least of the union
found in both), from one the number of distinct shingles, and from these the
containment.

Null and empty texts have the empty sketch; two empty sketches are alike (1), an
empty and another are not (0).  Equal texts have equal sketches.  The next
document is by descending id, ties by text, nulls last; after the last comes the
first.  Repeated rows follow one another.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_column, slices, text_col

K, WORDS, SEED = 128, 5, 3
#: Ranges of ids that the neighbour search works in, at most.
RANGES = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class Sketcher:
    """Sketches of UTF-8 texts; hashes of words seen before are looked up."""

    def __init__(self, k: int = K, words: int = WORDS, entries: int = 150_000):
        self.k, self.words, self.entries, self.known = k, words, entries, {}

    def hashes(self, split: list[bytes]) -> np.ndarray:
        if len(self.known) > self.entries:
            self.known.clear()
        known, digest = self.known, xxhash.xxh3_64_intdigest
        out = []
        for word in split:
            h = known.get(word)
            if h is None:
                known[word] = h = digest(word, SEED)
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        """The k least distinct shingle hashes, ascending."""
        split = text.lower().split()
        if not split:
            return np.zeros(0, np.uint64)
        h = self.hashes(split)
        n = min(self.words, len(h))
        mixed = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):  # order matters: multiply before each word
            mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * _MIX
            mixed ^= mixed >> np.uint64(31)
        mixed = mixed * _MIX2
        mixed ^= mixed >> np.uint64(29)
        if len(mixed) > 4 * self.k:  # enough for k distinct ones unless many repeat
            least = np.unique(np.partition(mixed, 2 * self.k)[: 2 * self.k])
            if len(least) >= self.k:
                return least[: self.k]
        return np.unique(mixed)[: self.k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|; exact where both sketches are below k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A|."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def load(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """(id, text, next_text): the text of the next document by descending id.

    Rows are dealt once, by ranges of ids with about as many rows each.  A range
    also gets the first row of the range that follows, found from the ids alone,
    so a window inside each range sees every neighbour.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col), key.alias("key"), text_col(text).alias("text"))
    ids = docs.select(key.alias("key"))
    cuts = sorted(set(ids.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array(F.lit(0))
    step = 1 << max(0, len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])
    place = F.aggregate(  # number of bounds at or below the key, by bisection
        steps, F.lit(0),
        lambda at, s: F.when(((at + s) <= F.lit(len(cuts))) & (F.get(bounds, at + s - 1) <= F.col("key")), at + s).otherwise(at),
    ) if cuts else F.lit(0)
    heads = {r["place"]: r["head"] for r in ids.withColumn("place", place).groupBy("place").agg(F.max("key").alias("head")).collect()}
    used = sorted(heads)
    # the head of each range is also the last row of the range above it; the first head, of the lowest range
    guests = {heads[p]: used[(i + 1) % len(used)] for i, p in enumerate(used)}
    placed = rows.withColumn("place", place)
    if guests:
        heads_map = F.create_map(*[F.lit(x) for pair in guests.items() for x in pair])
        copies = F.when(F.col("key").isin(list(guests)), F.array(
            F.struct(F.col("place").alias("place"), F.lit(0).alias("guest")),
            F.struct(F.element_at(heads_map, F.col("key")).alias("place"), F.lit(1).alias("guest")),
        )).otherwise(F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("guest"))))
        placed = placed.withColumn("to", F.explode(copies)).select(id_col, "key", "text", "to.place", "to.guest")
    else:
        placed = placed.withColumn("guest", F.lit(0))
    order = Window.partitionBy("place").orderBy(F.col("guest"), F.col("key").desc(), F.col("text"))
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select(id_col, "text", F.coalesce("next_text", "text").alias("next_text"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint, n_distinct) of each row's whole text."""
    def make():
        sketch = Sketcher(k)

        def work(texts: list[bytes]) -> dict:
            found = [sketch(t) for t in texts]
            return {"fingerprint": [dump(a) for a in found], "n_distinct": [distinct(a, k) for a in found]}

        return work

    return map_column(docs, make, "fingerprint string, n_distinct double", text, (id_col,), binary=True)


def merge_by(sketches: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint, n_distinct): one sketch of all texts of each key, null being a key.

    Every task first merges what it has of a key, so a key with very many rows
    sends one sketch per task; those are merged again after the shuffle.
    """
    rows = sketches.select(F.col(key).alias("key"), F.col(fingerprint).alias("fingerprint"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                new = load(text or "")
                held[name] = merge(held[name], new, k) if name in held else new[:k]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), batch.schema.field(0).type), pa.array([dump(a) for a in held.values()]), pa.array([distinct(a, k) for a in held.values()])],
                names=["key", "fingerprint", "n_distinct"],
            )

    schema = f"key {kind}, fingerprint string, n_distinct double"
    parts = rows.mapInArrow(run, schema).select("key", "fingerprint")
    return parts.repartition("key").mapInArrow(run, schema).withColumnRenamed("key", key)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced by
    the beginning of the next document), and their likeness."""
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - cut), F.col("next_text").substr(F.lit(1), cut)
    )
    pairs = with_next(docs, id_col, text).select(
        id_col, F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text"
    )
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, last = Sketcher(k), (None, None)
        for batch in batches:
            ids, n_chars, texts, edits, nexts = (batch.column(i) for i in range(5))
            edits, nexts = edits.cast(pa.binary()), nexts.cast(pa.binary())
            for a, b, own_texts in slices(texts, binary=True):
                out = []
                for t, e, n in zip(own_texts, edits.slice(a, b - a).to_pylist(), nexts.slice(a, b - a).to_pylist()):
                    own = last[1] if t == last[0] else sketch(t)  # mostly the neighbour of the row before
                    other = own if n == t else sketch(n)
                    last = (n, other)
                    edit = own if e == t else sketch(e)
                    out.append((hashlib.sha256(e).hexdigest(), dump(own), dump(edit), resemblance(own, edit, k), resemblance(own, other, k), distinct(own, k), containment(own, edit, k)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), n_chars.slice(a, b - a), *[pa.array(c) for c in columns]],
                    names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "contained_edited"],
                )

    return pairs.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained_edited double")
