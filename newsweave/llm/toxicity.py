"""Toxicity by multiple-instance learning (operator 6).

A text is a bag of sentences.  A sentence's score is the logistic of the sum of
its words' weights; a text's score is the noisy-or of its sentences,
1 - prod(1 - p).  The weights are trained from document labels alone, so the
sentence scores learn to point at what made a document toxic, and the operator
reports the offending sentences.

Sentences that don't offend (p below one half) have a small score each, and any
text that is long enough would be toxic by their number alone.  So what clean
texts of the sample have in them, by the number of sentences, is taken off their
part of the noisy-or; an offending sentence counts in full.

The model is fitted on a bounded sample of labelled rows (``sample`` ids, the first
by a hash, and ``most_bytes`` of text); the bounds are parameters.  Everything else covers
every row and whole texts.  Labels, language, source and id are no inputs.

Null and empty texts have no sentence with words and score as one empty sentence
(the bias alone).  Very long texts are scored whole.  Null labels are left out; rows
labelled twice count as toxic if either is; of several texts with one id the least is
fitted.  Equal texts score alike.  Columns with clashing names are passed on by
keep_clean() and not read otherwise.  Without labels of both kinds the model
scores 0 everywhere.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, labelled_sample, map_column, slices

#: Labelled rows that a model is fitted on at most, and hashed words.
SAMPLE, BITS = 8_000, 18
#: Bytes of their texts at most.
MOST_BYTES = 32_000_000
#: Lengths (bytes) of the beginnings of words that are features too.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.5
#: Texts that a word is in, and standard deviations by which its share of toxic texts differs, at least, to get a weight.
LEAST, EVIDENCE = 4, 4.0
#: Standard deviations by which sentences that don't offend may exceed those of clean texts.
DEVIATIONS = 3.0
# Sentences end at . ! ? and line ends; other ASCII that isn't alphanumeric parts words.
_CLEAN = bytes(
    10 if b in b".!?\n" else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


@dataclass
class Model:
    weights: np.ndarray  # by hashed word, float32
    bias: float
    rate: float = 0.0  # mean and deviation of what a sentence of a clean text adds to the noisy-or
    spread: float = 0.0


def features(word: bytes, mask: int) -> tuple[int, ...]:
    """Hashed features of a word: itself and, marked as such, its beginnings."""
    return (zlib.crc32(word) & mask, *(zlib.crc32(b"%d^" % n + word[:n]) & mask for n in STEMS if len(word) >= n))


_cached = lru_cache(maxsize=50_000)(features)


def sentences(text: bytes) -> tuple[list[set[bytes]], np.ndarray]:
    """Distinct words of each sentence, and where each sentence ends (bytes)."""
    lines = text.lower().translate(_CLEAN).split(b"\n")
    return [set(line.split()) for line in lines], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)


def bag(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text's sentences end to end, and how many each has."""
    per = [[f for w in sorted(words) for f in _cached(w, (1 << bits) - 1)] for words in sentences(text)[0]]
    return np.array([f for fs in per for f in fs], np.int64), np.array([len(fs) for fs in per], np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; an empty run sums to 0."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 60, least: int = LEAST, evidence: float = EVIDENCE, rate: float = 0.15, decay: float = 3e-4, toxic_weight: float = 4.0) -> Model:
    """Fit by full-batch Adam on the noisy-or likelihood, toxic texts counting ``toxic_weight`` times.

    bags: hashed words and words by sentence of each text.  Words in fewer than
    ``least`` of them, or whose share of toxic texts is within ``evidence``
    standard deviations of the common one, keep weight 0.
    """
    if not len(bags) or labels.min() == labels.max():
        return untrained(bits)
    found, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    for (words, _), label in zip(bags, labels):
        own = np.unique(words)
        found[own] += 1
        toxic[own] += label
    active = telling(found, toxic, labels.mean(), least, evidence)
    kept = [telling_words(w, c, active) for w, c in bags]
    per_bag = np.array([len(c) for _, c in bags])
    return descend(
        np.concatenate([w for w, _ in kept]), np.concatenate([c for _, c in kept]), np.concatenate([c for _, c in bags]) > 0,
        per_bag, labels, active, bits, epochs, rate, decay, toxic_weight,
    )


def untrained(bits: int = BITS) -> Model:
    """What labels of one kind give."""
    return Model(np.zeros(1 << bits, np.float32), -60.0)


def telling(found: np.ndarray, toxic: np.ndarray, share: float, least: int, evidence: float) -> np.ndarray:
    """Words that get a weight, in order, from the texts and toxic texts that each word is found in."""
    excess = (toxic - share * found) / np.sqrt(np.maximum(share * (1 - share) * found, 1e-9))
    return np.flatnonzero((found >= least) & (np.abs(excess) >= evidence))


def telling_words(words: np.ndarray, counts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bag without the words that get no weight: places in ``active`` and words by sentence."""
    if not len(active):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    place = np.minimum(np.searchsorted(active, words), len(active) - 1)
    keep = active[place] == words
    return place[keep], sums(keep, counts).astype(np.int64)


def descend(
    words: np.ndarray, counts: np.ndarray, real: np.ndarray, per_bag: np.ndarray, labels: np.ndarray, active: np.ndarray, bits: int = BITS,
    epochs: int = 60, rate: float = 0.15, decay: float = 3e-4, toxic_weight: float = 4.0,
) -> Model:
    """The steps of train().  words, counts: bags as of telling_words(), end to end; real: whether a sentence has words
    at all; per_bag: sentences of each bag."""
    weights = np.zeros(1 << bits, np.float32)
    sentence_of = np.repeat(np.arange(len(counts)), counts)
    bag_of, n_sentences = np.repeat(np.arange(len(per_bag)), per_bag), len(counts)
    y = labels.astype(float)
    base = y.mean()
    theta = np.zeros(len(active) + 1)
    theta[-1] = np.log(base / per_bag.mean())
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = np.bincount(sentence_of, theta[words], n_sentences) + theta[-1]
        none = np.bincount(bag_of, softplus(z), len(per_bag))  # -log of no toxic sentence
        p = -np.expm1(-none)
        # d loss / d z_s: s(z) for clean texts, -(1-P)/P s(z) times their weight for toxic ones
        pull = np.where(y > 0, -toxic_weight * np.exp(-none) / np.maximum(p, 0.02), 1.0) / len(per_bag)
        dz = pull[bag_of] / (1.0 + np.exp(-np.clip(z, -60, 60)))
        grad = np.r_[np.bincount(words, dz[sentence_of], len(active)), dz.sum()]
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[active] = theta[:-1]
    z = np.bincount(sentence_of, theta[words], n_sentences) + theta[-1]
    usual = softplus(z[real & (z < 0) & (y[bag_of] == 0)])
    rate, spread = (float(usual.mean()), float(usual.std())) if len(usual) else (0.0, 0.0)
    return Model(weights, float(theta[-1]), rate, spread)


def evidence_of(z: np.ndarray, model: Model, deviations: float = DEVIATIONS) -> float:
    """-log of no toxic sentence: offending sentences in full, of the others what exceeds
    the sum of as many sentences of clean texts by so many standard deviations."""
    n = int((z < 0).sum())
    usual = n * model.rate + deviations * model.spread * np.sqrt(n)
    return float(softplus(z[z >= 0]).sum() + max(softplus(z[z < 0]).sum() - usual, 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text: str = "text", modulus: int = 5, held_out: int = 0, bits: int = BITS) -> Model:
    """A model of the labelled rows whose crc32(id) mod ``modulus`` isn't ``held_out``.

    Words are counted by Spark, and only those that get a weight go to the driver, sentence by sentence.
    """
    rows = labelled_sample(docs, labels, label, 6, sample, most_bytes, id_col, text, modulus, held_out)

    def work(texts: list[bytes]) -> dict:
        bags = [bag(t, bits) for t in texts]
        return {"words": pa.array([w for w, _ in bags], pa.list_(pa.int32())), "counts": pa.array([c for _, c in bags], pa.list_(pa.int32()))}

    bags = checkpoint(map_column(rows, lambda: work, "words array<int>, counts array<int>", "text", ("id", "label"), binary=True))
    n, positive = bags.agg(F.count("*"), F.sum("label")).first()
    if positive in (None, 0, n):
        return untrained(bits)
    by_word = (
        bags.select("label", F.explode(F.array_distinct("words")).alias("word"))
        .groupBy("word").agg(F.count("*").alias("found"), F.sum("label").alias("toxic")).where(F.col("found") >= LEAST).toArrow()
    )
    found, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    found[by_word["word"].to_numpy()], toxic[by_word["word"].to_numpy()] = by_word["found"].to_numpy(), by_word["toxic"].to_numpy()
    active = telling(found, toxic, positive / n, LEAST, EVIDENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            counts = [np.asarray(c.values.to_numpy(), np.int64) for c in batch.column(3)]
            kept = [telling_words(w.values.to_numpy(), c, active) for w, c in zip(batch.column(2), counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[k] for x in kept], ints) for k in (0, 1)), pa.array([c > 0 for c in counts], pa.list_(pa.bool_()))],
                names=["id", "label", "words", "counts", "real"],
            )
        pa.default_memory_pool().release_unused()

    id_type = bags.schema["id"].dataType.simpleString()
    kept = bags.mapInArrow(run, f"id {id_type}, label int, words array<int>, counts array<int>, real array<boolean>").toArrow().sort_by("id")
    per_bag = np.array([len(c) for c in kept["counts"]])
    words, counts, real = (pa.concat_arrays([c.flatten() for c in kept[name].chunks]).to_numpy(zero_copy_only=False) for name in ("words", "counts", "real"))
    labels_ = kept["label"].to_numpy().astype(np.int64)
    del kept
    pa.default_memory_pool().release_unused()
    return descend(words, counts, real, per_bag, labels_, active, bits)


class Scorer:
    """Scores of texts; weights of words seen before are looked up."""

    def __init__(self, model: Model, entries: int = 100_000):
        self.model, self.entries, self.known = model, entries, {}
        self.mask = len(model.weights) - 1

    def __call__(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """Score of the text, of its sentences, and where these end."""
        if len(self.known) > self.entries:
            self.known.clear()
        known, weights = self.known, self.model.weights
        bags, ends = sentences(text)
        values = []
        for words in bags:
            for w in words:
                x = known.get(w)
                if x is None:
                    known[w] = x = float(sum(weights[f] for f in features(w, self.mask)))
                values.append(x)
        counts = np.fromiter(map(len, bags), np.int64, len(bags))
        z = sums(np.array(values), counts) + self.model.bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))
        real = counts > 0
        p[~real] = 0.0
        none = evidence_of(z[real], self.model) if real.any() else softplus(self.model.bias)
        return float(-np.expm1(-none)), p, ends


def spans(text: bytes, p: np.ndarray, ends: np.ndarray, least: float = THRESHOLD) -> str:
    """start:end of the sentences that score ``least`` or more, in code points."""
    out = []
    for k in np.flatnonzero(p >= least):
        a, b = int(ends[k - 1]) if k else 0, min(int(ends[k]), len(text))
        start = len(text[:a].decode())
        out.append(f"{start}:{start + len(text[a:b].decode())}")
    return ",".join(out)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, sentences): sentences are the offending ones' spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^bits weights

    def make():
        scorer = Scorer(shared.value)

        def work(texts: list[bytes]) -> dict:
            found = [scorer(t) for t in texts]
            return {
                "score": [s for s, _, _ in found], "predicted": pa.array([int(s >= threshold) for s, _, _ in found], pa.int32()),
                "sentences": [spans(t, p, e) for t, (_, p, e) in zip(texts, found)],
            }

        return work

    return map_column(docs, make, "score double, predicted int, sentences string", text, (id_col,), binary=True)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; columns stay as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            clean = [scorer(t)[0] < threshold for _, _, texts in slices(batch.column(at), binary=True) for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
