"""Quality classifier (operator 1): a factorisation machine.

Features of a text are its distinct words, hashed and with values that sum to
one in square; structure statistics (lengths, shares of kinds of characters,
repeats of words and lines), each as one of ``BINS`` indicator features; and
numeric metadata columns, binned alike.  The score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

which has all pairwise interactions in time linear in the features.

The model is fitted on a bounded sample of labelled rows (``sample`` ids, the first
by a hash, and ``most_bytes`` of text); bin edges come from that sample too.  Everything else
covers every row and whole texts.  Labels, language, source and id are no inputs.

Null texts are empty; an empty text scores by its statistics alone.  A missing
metadata value has no feature.  Very long texts are read whole.  Null labels are left out; rows labelled
twice take the larger label; of several rows with one id the one with the least text is
fitted.  Columns other than id, text and metadata aren't read, whatever their names.  Equal texts with equal metadata score alike.  Without
labels of both kinds the score is the common label (0.5 without labels).  An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_column, slices, text_col

SAMPLE, BITS, FACTORS, BINS = 8_000, 14, 8, 12
THRESHOLD = 0.7
#: Bytes of the sample's texts at most.
MOST_BYTES = 32_000_000
STATS = (
    "bytes", "words", "mean_word", "upper", "digit", "punctuation", "symbol", "exclamation", "non_ascii",
    "distinct_words", "top_word", "repeated_lines", "mean_line",
)
_SYMBOLS = list(b"#$%&*+/<=>@\\^_`|~{}[]")
_PUNCTUATION = list(b".,;:?'\"()-")


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, FACTORS)
    edges: np.ndarray  # (statistics and metadata, BINS - 1)


class Features:
    """Hashed words and raw statistics of UTF-8 texts."""

    def __init__(self, bits: int = BITS, entries: int = 200_000):
        self.mask, self.entries, self.known = (1 << bits) - 1, entries, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, list[float]]:
        if len(self.known) > self.entries:
            self.known.clear()
        known, mask = self.known, self.mask
        words = []
        for w in text.lower().split():
            h = known.get(w)
            if h is None:
                known[w] = h = zlib.crc32(w) & mask
            words.append(h)
        own, counts = np.unique(np.array(words, np.int64), return_counts=True)
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n, n_words = max(len(text), 1), max(len(words), 1)
        lines = text.split(b"\n")
        stats = [
            np.log2(len(text) + 1), np.log2(len(words) + 1), len(text) / n_words, kinds[65:91].sum() / n,
            kinds[48:58].sum() / n, kinds[_PUNCTUATION].sum() / n, kinds[_SYMBOLS].sum() / n, kinds[33] / n,
            kinds[128:].sum() / n, len(own) / n_words, counts.max(initial=0) / n_words,
            1.0 - sum(map(len, set(lines))) / max(sum(map(len, lines)), 1), np.log2(len(text) / len(lines) + 1),
        ]
        return own, stats


def binned(stats: np.ndarray, edges: np.ndarray, first: int) -> np.ndarray:
    """Indicator feature of each statistic, (rows, statistics); -1 where it is missing."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        out[:, k] = first + k * BINS + np.searchsorted(edges[k], stats[:, k], side="right")
    return np.where(np.isnan(stats), -1, out)


def assemble(words: list[np.ndarray], bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, values and row starts of a batch."""
    index, value, size = [], [], []
    for w, b in zip(words, bins):
        b = b[b >= 0]
        index += [w, b]
        value += [np.full(len(w), 1.0 / np.sqrt(max(len(w), 1))), np.ones(len(b))]
        size.append(len(w) + len(b))
    ends = np.cumsum(size)
    return np.concatenate(index), np.concatenate(value), ends - size


def evaluate(model: Model, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log odds of each row, in linear time."""
    vx = model.factors[index] * value[:, None]
    linear = np.add.reduceat(model.weights[index] * value, starts)
    total, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
    return model.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)


def train(
    words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, bits: int = BITS, epochs: int = 12, batch: int = 256,
    least: int = 8, rate: float = 0.02, decay: float = 1e-4, seed: int = 1,
) -> Model:
    """Fit by mini-batch Adam on the logistic loss; words in fewer than ``least`` rows are left at 0."""
    n_stats, first = stats.shape[1], 1 << bits
    n_features = first + n_stats * BINS
    share = labels.mean() if len(labels) else 0.5
    model = Model(0.0, np.zeros(n_features), np.zeros((n_features, FACTORS)), np.zeros((n_stats, BINS - 1)))
    if not len(labels) or share in (0.0, 1.0):
        model.bias = {0.0: -20.0, 1.0: 20.0}.get(float(share), 0.0)
        return model
    for k in range(n_stats):
        real = stats[~np.isnan(stats[:, k]), k]
        if len(real):
            model.edges[k] = np.quantile(real, np.arange(1, BINS) / BINS)
    bins = binned(stats, model.edges, first)
    often = np.bincount(np.concatenate([*words, np.zeros(0, np.int64)]), minlength=first) >= least
    index, value, starts = assemble(words, bins)
    keep = np.r_[often, np.ones(n_stats * BINS, bool)]
    value = value * keep[index]
    ends = np.r_[starts[1:], len(index)]
    rng = np.random.default_rng(seed)
    theta = np.zeros((n_features + 1, 1 + FACTORS))  # last row: bias
    theta[:-1, 1:] = rng.normal(0, 0.05, (n_features, FACTORS))
    theta[:-1] *= keep[:, None]
    theta[-1, 0] = np.log(share / (1 - share))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            size = ends[rows] - starts[rows]
            at = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            i, x, of, begin = index[at], value[at], np.repeat(np.arange(len(rows)), size), np.cumsum(size) - size
            vx = theta[i, 1:] * x[:, None]
            total = np.add.reduceat(vx, begin)
            z = theta[-1, 0] + np.add.reduceat(theta[i, 0] * x, begin) + 0.5 * (total**2 - np.add.reduceat(vx * vx, begin)).sum(axis=1)
            pull = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            px = pull[of] * x
            grad = np.empty_like(theta)
            grad[:, 0] = np.bincount(i, px, n_features + 1)
            inner = total[of] - vx
            for f in range(FACTORS):
                grad[:, 1 + f] = np.bincount(i, px * inner[:, f], n_features + 1)
            grad += decay * theta
            grad[-1] = [pull.sum(), *[0.0] * FACTORS]
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[:-1] *= keep[:, None]
    model.bias, model.weights, model.factors = float(theta[-1, 0]), theta[:-1, 0].copy(), theta[:-1, 1:].copy()
    return model


def _metadata(docs: DataFrame, metadata: Sequence[str]) -> list:
    return [F.log2(F.greatest(F.col(c).cast("double"), F.lit(0.0)) + 1).alias(f"__m{k}") for k, c in enumerate(metadata)]


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, most_bytes: int = MOST_BYTES, metadata: Sequence[str] = ("n_chars",),
    id_col: str = "doc_id", text: str = "text", modulus: int = 4, held_out: int = 2, bits: int = BITS,
) -> Model:
    """A model of the labelled rows whose crc32(id) mod ``modulus`` isn't ``held_out``."""
    names = [f"__m{k}" for k in range(len(metadata))]
    rows = labelled_sample(docs, labels, label, 1, sample, most_bytes, id_col, text, modulus, held_out, _metadata(docs, metadata))

    def make():
        extract = Features(bits)

        def work(texts: list[bytes]) -> dict:
            found = [extract(t) for t in texts]
            return {
                "words": pa.array([w for w, _ in found], pa.list_(pa.int32())),
                "stats": pa.array([s for _, s in found], pa.list_(pa.float64())),
            }

        return work

    found = map_column(rows, make, "words array<int>, stats array<double>", "text", ("id", "label", *names), binary=True).toArrow()
    found = found.sort_by("id") if found.num_rows else found
    words = [np.asarray(w.values.to_numpy(), np.int64) for w in found["words"]]
    stats = np.array(found["stats"].to_pylist(), float).reshape(len(words), len(STATS))
    extra = [np.array(found[n].to_pylist(), float).reshape(len(words)) for n in names]
    return train(words, np.column_stack([stats, *extra]), np.array(found["label"].to_pylist(), float), bits)


def score(
    docs: DataFrame, model: Model, metadata: Sequence[str] = ("n_chars",), id_col: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, score, predicted) for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^bits features
    values = F.array(*_metadata(docs, metadata)) if metadata else F.array().cast("array<double>")
    source = docs.select(id_col, text_col(text).alias("text"), values.alias("meta"))
    kind = source.schema.fields[0].dataType.simpleString()

    def run(batches):
        model, extract = shared.value, Features(BITS)
        extract.mask = len(model.weights) - len(model.edges) * BINS - 1
        first = extract.mask + 1
        for batch in batches:
            meta = batch.column(2).to_pylist()
            for a, b, texts in slices(batch.column(1), binary=True, limit=1_000_000):
                found = [extract(t) for t in texts]
                stats = np.array([s + [np.nan if x is None else x for x in m] for (_, s), m in zip(found, meta[a:b])])
                z = evaluate(model, *assemble([w for w, _ in found], binned(stats, model.edges, first)))
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=[id_col, "score", "predicted"],
                )

    return source.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
