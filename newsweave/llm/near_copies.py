"""Near copies by similarity: what the pipeline's near-dedup stage drops.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is ``least`` = 0.8 or more; classes are the connected components of
these links.  (Operator 5, ``simhash``, has a contract of its own: three words,
three bits.)

Families first, exactly then.  At similarity 0.8 SimHashes differ in about ten of 64 bits, more
than pieces of a fingerprint can find in linear time, so texts meet in buckets by MinHash: 20 bands
of five least hashes each, at least one of which a pair of similarity 0.8 shares with
probability 0.9996.  In a bucket, SimHashes are compared bit-sliced, as in operator 5 but within
wider radii (``RADII``, to 26 bits, which a pair of similarity 0.8 exceeds once in 10^7), and give
stars of what is near.  A bucket of over ``most`` texts is taken as near as a whole.  The
components of these unchecked links are families: a link between near copies never leaves one.

In a family all pairs of texts are then compared by their whole sets of shingles.  A family is
cut into blocks of about 1,024 texts and 512,000 shingles, and each two blocks meet in
one group, whose common shingles are counted by products of bit matrices; so a family of any size is
compared whole, in pieces of bounded size, and gives a spanning forest of checked links for
each two blocks.  Texts outside families move nowhere.

Texts are told apart by 128 bits (MD5).  Equal texts are one node.  Null, empty and blank texts are
one class.  A class keeps the row with the least id (nulls last); rows with the same id and text
count once (of those that differ elsewhere, one by a hash of the row).  Very long texts are
shingled in parts and compared by their sets of hashes.  Columns are renamed inside, so no name
clashes.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bottomk import _MIX, _MIX2, Sketcher
from .common import checkpoint, map_column, one_row, text_col
from .components import connected_components
from .simhash import Sliced

WORDS, LEAST, BANDS, ROWS, MOST = 5, 0.8, 20, 5, 4096
#: Radii (bits) by which a bucket's forest grows.
RADII = (6, 13, 20, 26)
#: Texts and shingles (about) in a block of a family; columns of a bit matrix.
MEMBERS, SHINGLES, COLUMNS = 1024, 512_000, 4096
#: Rows (of a few numbers each) that are broadcast at most.
BROADCAST_ROWS = 500_000
_DRAWN = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


class Shingler(Sketcher):
    """Hashes of the five-word shingles of UTF-8 texts, in order; of the whole text if it has fewer words."""

    def __init__(self, words: int = WORDS, entries: int = 150_000):
        super().__init__(words=words, entries=entries)

    def __call__(self, text: bytes) -> np.ndarray:
        h = self.hashes(text.lower().split())
        if not len(h):
            return h
        n = min(self.words, len(h))
        mixed = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * _MIX
            mixed ^= mixed >> np.uint64(31)
        mixed = (mixed + np.uint64(n)) * _MIX2
        return mixed ^ mixed >> np.uint64(29)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Keys of the bands, and the SimHash of the shingles."""
    least, count = np.full(BANDS * ROWS, ~np.uint64(0)), np.zeros(64, np.int64)
    for a in range(0, len(shingles), 1024):  # stays in the cache
        part = shingles[a : a + 1024]
        np.minimum(least, ((part ^ _FLIP) * _TIMES).min(axis=1), out=least)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ least.reshape(BANDS, ROWS)[:, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key * _MIX2, _BITS[2 * count > len(shingles)].sum(dtype=np.uint64)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) enough to join what all of them join; ``label`` is brought up to date."""
    chosen_a, chosen_b = [a[:0]], [b[:0]]
    while True:
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        if not len(a):
            return np.concatenate(chosen_a), np.concatenate(chosen_b)
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        roots, first = np.unique(high, return_index=True)
        chosen_a.append(a[first])
        chosen_b.append(b[first])
        parent = np.arange(len(label))
        parent[roots] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


def near_forest(fps: np.ndarray, starts: np.ndarray, radii: tuple[int, ...] = RADII) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the members of each run that are within the last radius, by one
    radius after another."""
    cut = Sliced(fps, starts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    label = np.arange(len(fps))
    width = cut.blocks[cut.run_of]
    row = np.repeat(np.arange(len(fps)), width)
    block = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + cut.first_block[cut.run_of[row]]
    for radius in radii:
        for k in range(0, len(row), 65_536):
            found.append(join(label, *cut.pairs(row[k : k + 65_536], block[k : k + 65_536], radius)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def compare_bands(dealt: DataFrame, most: int) -> DataFrame:
    """Rows (band, t, fp) -> stars (a, b) of near members of each bucket, the least in the middle; one
    star of all members of a bucket of over ``most``.  From stars, components are found in few rounds."""

    def close(band: np.ndarray, t: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        size = np.diff(np.r_[starts, len(band)])
        many = np.repeat(size > 1, size)
        kept = size[size > 1]
        t = t[many]
        label = np.arange(len(t))
        join(label, *near_forest(fp[many], np.cumsum(kept) - kept))
        y = np.flatnonzero(label != np.arange(len(t)))
        return _edges(t[label[y]], t[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        flowing = None  # band and least member of a bucket that is already too large
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            held = [np.concatenate([h, c.view(h.dtype)]) for h, c in zip(held, new)]
            if flowing is not None and len(held[0]):
                same = int(np.searchsorted(held[0], flowing[0], side="right"))
                yield _edges(np.full(same, flowing[1]), held[1][:same])
                flowing = flowing if same == len(held[0]) else None
                held = [h[same:] for h in held]
            if not len(held[0]):
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))
            if end:
                bands, size = np.unique(held[0][:end], return_counts=True)
                large = np.repeat(size > most, size)
                if large.any():
                    t, band = held[1][:end][large], held[0][:end][large]
                    yield _edges(t[np.searchsorted(band, band)], t)
                yield close(*(h[:end][~large] for h in held))
                held = [h[end:] for h in held]
            if len(held[0]) > most:
                yield _edges(np.full(len(held[1]) - 1, held[1][0]), held[1][1:])
                flowing = (held[0][0], held[1][0])
                held = [h[:0] for h in held]
        if len(held[0]):
            yield close(*held)
        pa.default_memory_pool().release_unused()

    ordered = dealt.repartition("band").sortWithinPartitions("band", "t")
    return ordered.select("band", "t", "fp").mapInArrow(run, "a long, b long")


def checked(sets: list[np.ndarray], first: int, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the pairs of sorted sets whose similarity is ``least`` or more;
    if 0 < ``first`` < len(sets), only pairs of one of the first so many with another one."""
    size = np.array([len(x) for x in sets])
    across = (np.arange(len(sets)) < first) if first < len(sets) else None
    columns, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[where]
    row = np.repeat(np.arange(len(sets)), size)
    row, place = row[place >= 0], place[place >= 0]
    if len(sets) > 2:  # in the order of their columns, to fill one matrix after another
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    total = int((count > 1).sum())
    if len(sets) == 2:
        both[0, 1] = total
    else:
        for k in range(0, total, COLUMNS):
            a, b = np.searchsorted(place, [k, k + COLUMNS])
            bits = np.zeros((len(sets), min(COLUMNS, total - k)), np.float32)
            bits[row[a:b], place[a:b] - k] = 1
            both += bits @ bits.T  # whole numbers below 2^24
    a, b = np.nonzero(np.triu(both >= least * (size[:, None] + size[None, :] - both) - 1e-6, 1) | np.triu((size[:, None] + size[None, :]) == 0, 1))
    if across is not None:
        a, b = a[across[a] != across[b]], b[across[a] != across[b]]
    return join(np.arange(len(sets)), a, b)


def check(dealt: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (root, i, j, block, t, shingles), where blocks i and j of a family meet -> a forest (a, b)
    of each group's near copies.  Shingles are sorted sets of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts, seconds = None, [], []

        def close() -> pa.RecordBatch:
            members = firsts + seconds
            found = _edges(np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(members) > 1 and (firsts or group[1] == group[2]):
                t = np.array([m[0] for m in members], np.int64)
                a, b = checked([np.frombuffer(m[1], np.uint64) for m in members], len(firsts) if group[1] != group[2] else len(members), least)
                found = _edges(t[a], t[b])
            return found

        for batch in batches:
            root, i, j, block, t = (batch.column(k).to_pylist() for k in range(5))
            for k in range(len(t)):
                key = (root[k], i[k], j[k])
                if key != group:
                    if group:
                        yield close()
                    group, firsts, seconds = key, [], []
                (firsts if block[k] == i[k] else seconds).append((t[k], batch.column(5)[k].as_py()))
        if group:
            yield close()
        pa.default_memory_pool().release_unused()

    ordered = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "t")
    return ordered.select("root", "i", "j", "block", "t", "shingles").mapInArrow(run, "a long, b long")


def text_key(text: str) -> Column:
    """128 bits by which a text is known."""
    return F.unhex(F.md5(text_col(text).cast("binary")))


def nodes_of(docs: DataFrame, text: str) -> DataFrame:
    """(h, t, bands, fp, n) for each different text: its key, a number, bands, SimHash, shingles."""

    def make():
        shingles = Shingler()

        def work(texts: list[bytes]) -> dict:
            hashed = [shingles(x) for x in texts]
            found = [signature(x) for x in hashed]
            return {
                "bands": pa.array([k.view(np.int64) for k, _ in found], pa.list_(pa.int64())),
                "fp": np.array([f for _, f in found], np.uint64).view(np.int64), "n": np.array([len(x) for x in hashed], np.int64),
            }

        return work

    source = docs.select(text_key(text).alias("h"), text_col(text).alias("text"))
    marked = map_column(source, make, "bands array<long>, fp long, n long", "text", ("h",), binary=True)
    once = marked.groupBy("h").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    return checkpoint(once.withColumn("t", F.monotonically_increasing_id()))


def families(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(h, t, root, k) for each text of a family: its family, and in how many blocks that is cut."""
    edges = compare_bands(nodes.select(F.explode("bands").alias("band"), "t", "fp"), most).distinct()
    roots = connected_components(edges).withColumnRenamed("node", "t")
    members = checkpoint(nodes.join(roots, "t").select("h", "t", "root", "n"))
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES, F.lit(1.0))).cast("int")
    return members.join(members.groupBy("root").agg(blocks.alias("k")), "root").select("h", "t", "root", "k")


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", least: float = LEAST, most: int = MOST) -> DataFrame:
    """Checked links (a, b), a < b, whose components are the classes of near copies; a and b are
    numbers (t) of ``nodes``."""

    def make():
        shingles = Shingler()
        return lambda texts: {"shingles": pa.array([np.unique(shingles(x)).tobytes() for x in texts], pa.binary())}

    members = checkpoint(families(nodes, most))
    found = docs.select(text_key(text).alias("h"), text_col(text).alias("text")).join(small(members), "h")
    sets = map_column(found, make, "shingles binary", "text", ("t", "root", "k"), binary=True)
    once = checkpoint(sets.groupBy("t", "root", "k").agg(F.first("shingles").alias("shingles")))
    block = F.pmod(F.xxhash64("t"), F.col("k")).cast("int").alias("block")
    dealt = once.select("root", "t", "shingles", block, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("with"))
    return check(dealt.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "t", "shingles"), least)


def small(df: DataFrame) -> DataFrame:
    """df (checkpointed, of short rows) to be broadcast if it has up to ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST, most: int = MOST) -> DataFrame:
    """docs with one row of each class; columns stay as they are, whatever their names.

    Rows are known by text and id.  Those that go are filtered out where they are, without moving
    a text, as long as their keys can be broadcast; of rows that are repeated only these few move,
    combined before.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text_ = f"c{names.index(id_col)}", f"c{names.index(text)}"
    nodes = nodes_of(inner, text_)
    roots = connected_components(links(inner, nodes, text_, least, most)).withColumnRenamed("node", "t")
    rooted = nodes.select("h", "t").join(roots, "t", "left").select("h", F.coalesce("root", "t").alias("root"))
    rows = checkpoint(inner.select(text_key(text_).alias("h"), F.col(id_).alias("id")).groupBy("h", "id").agg(F.count("*").alias("count")))
    named = checkpoint(rows.join(rooted, "h"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k"))
    kept = first.select(F.col("k.h").alias("kept_h"), F.col("k.id").alias("kept_id"))
    stays = (F.col("h") == F.col("kept_h")) & F.col("id").eqNullSafe(F.col("kept_id"))
    marked = named.join(kept, stays, "left").select("h", "id", "count", F.col("kept_h").isNotNull().alias("kept"))
    other = checkpoint(marked.where("count > 1 or not kept").select(F.col("h").alias("other_h"), F.col("id").alias("other_id"), "kept"))
    is_other = (text_key(text_) == F.col("other_h")) & F.col(id_).eqNullSafe(F.col("other_id"))
    single = inner.join(small(other), is_other, "left_anti")
    again = checkpoint(other.where("kept"))
    if not again.limit(1).count():
        return single.toDF(*names)
    repeated = inner.join(small(again), is_other).drop("kept")
    return single.unionByName(one_row(repeated, "other_h", "other_id").select(*inner.columns)).toDF(*names)
