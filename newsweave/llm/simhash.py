"""SimHash near-duplicates by bit-sliced comparison (operator 5).

Fingerprints: 64 bits from the XXH64 of every 3-word shingle of the whole text.
Two texts are linked if their fingerprints differ in at most ``radius`` = 3
bits; classes are the connected components of the links.

Equal fingerprints are one node.  Distinct ones meet in buckets that share two
of sixteen pieces (blocks of 16 bits, each in four): any pair within the radius
agrees on at least one block of four and, in the other 48 bits, on at least one
quarter, so no link is lost.  In a bucket, bit planes are stored vertically (one
64-bit word holds one bit of 64 fingerprints), distances grow in carry-save
counters, and words whose lanes all exceed the radius are abandoned.  A bucket
of more than ``most`` fingerprints is never compared as it is: its rows go to a
next level with more shared bits.  From a bucket comes a spanning forest of
links, not all pairs.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows and ties share a fingerprint; a class takes its least doc_id (null
ids don't count unless there is no other).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_column, one_row, slices
from .components import connected_components

WORDS, RADIUS, MOST = 3, 3, 4096
FULL = 2**64 - 1


def fingerprints(texts: list[bytes], words: int = WORDS, seed: int = 42) -> np.ndarray:
    """SimHash of each UTF-8 text, as uint64."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        split = text.lower().split()
        if not split:
            continue
        line = b" ".join(split)
        if len(split) <= words:
            hashes = [digest(line, seed)]
        else:
            ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
            starts = [0, *ends[:-words].tolist()]
            hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
        count, n = np.zeros(64, np.int64), len(hashes)
        for a in range(0, n, 1 << 16):  # very long texts in parts
            part = np.array(hashes[a : a + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * count > n].sum()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    return map_column(
        docs, lambda: lambda texts: {"fp": fingerprints(texts).view(np.int64)}, "fp long", text, (id_col,), binary=True
    )


def quarters(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The bits outside ``mask`` in radius + 1 nearly equal pieces, as masks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def first_masks() -> list[int]:
    return [block | piece for block in quarters(0) for piece in quarters(block)]


def splits(mask: int) -> bool:
    """Whether buckets of this mask may be dealt anew; with 12 free bits they are small."""
    return 64 - int(mask).bit_count() > 12


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64 planes): bit k of plane b of a block is bit b of its k-th fingerprint."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(bits.transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def near_lanes(fps: np.ndarray, row: np.ndarray, block: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each entry (row, block): a word whose lanes are 1 where distance <= radius.

    Carry-save: each lane has a counter of as many planes as the radius needs, which
    begins so that the bit beyond the radius carries out of it into the sticky
    ``over``.  Entries whose lanes are all over are dropped every eight planes.
    """
    width = radius.bit_length()
    begin = (1 << width) - 1 - radius
    result = np.zeros(len(row), np.uint64)
    live = np.arange(len(row))
    counter = [np.full(len(row), FULL if begin >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(len(row), np.uint64)
    for b in range(64):
        bit = np.zeros(len(live), np.uint64) - (fps[row[live]] >> np.uint64(b) & np.uint64(1))
        carry = planes[block[live], b] ^ bit
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 7:
            keep = over != np.uint64(FULL)
            if not keep.all():
                live, over, counter = live[keep], over[keep], [c[keep] for c in counter]
            if not len(live):
                return result
    result[live] = ~over
    return result


class Sliced:
    """Runs of fingerprints in blocks of 64 lanes, a run's last block being padded."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        self.fps, self.starts = fps, starts
        self.size = np.diff(np.r_[starts, len(fps)])
        self.blocks = -(-self.size // 64)
        self.first_block = np.cumsum(self.blocks) - self.blocks
        self.run_of = np.repeat(np.arange(len(self.size)), self.size)
        self.lane = np.arange(len(fps)) - starts[self.run_of]
        spot = (self.first_block[self.run_of] + self.lane // 64) * 64 + self.lane % 64
        n = int(self.blocks.sum())
        padded, filled = np.zeros(n * 64, np.uint64), np.zeros(n * 64, np.uint8)
        padded[spot], filled[spot] = fps, 1
        self.planes = np.zeros((n, 64), np.uint64)
        for a in range(0, n, 4096):
            self.planes[a : a + 4096] = planes_of(padded[a * 64 : (a + 4096) * 64])
        self.valid = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]

    def near(self, row: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
        """Words of near lanes; lanes past a run's end are 0."""
        return near_lanes(self.fps, row, block, self.planes, radius) & self.valid[block]

    def pairs(self, row: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, other) of the near lanes but the row's own."""
        lanes = self.near(row, block, radius)
        busy = np.flatnonzero(lanes)
        who, where = np.nonzero(np.unpackbits(lanes[busy].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a = row[busy[who]]
        b = self.starts[self.run_of[a]] + (block[busy[who]] - self.first_block[self.run_of[a]]) * 64 + where
        return a[a != b], b[a != b]


def forest(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components inside each run of ``fps``.

    Runs begin at ``starts``; only members of one run are compared.
    """
    cut = Sliced(fps, starts)
    size, run_of, small = cut.size, cut.run_of, cut.size <= 64
    label = np.arange(len(fps))
    # Runs of one block: all rows at once, then least labels until they settle.
    rows = np.flatnonzero(small[run_of])
    if len(rows):
        a, b = cut.pairs(rows, cut.first_block[run_of[rows]], radius)
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (label == before).all():
                break
    # Larger runs: breadth first over words of lanes.
    for r in np.flatnonzero(~small):
        s, m, w = starts[r], size[r], cut.blocks[r]
        row = np.repeat(np.arange(s, s + m), w)
        block = np.tile(np.arange(cut.first_block[r], cut.first_block[r] + w), m)
        near = np.concatenate([
            cut.near(row[k : k + 262_144], block[k : k + 262_144], radius) for k in range(0, len(row), 262_144)
        ]).reshape(m, w)
        todo = np.ones(m, bool)
        for seed in range(m):
            if not todo[seed]:
                continue
            front = np.array([seed])
            todo[seed] = False
            while len(front):
                reach = np.bitwise_or.reduce(near[front], axis=0).view(np.uint8)
                got = np.unpackbits(reach, bitorder="little")[:m].astype(bool) & todo
                front = np.flatnonzero(got)
                todo[front] = False
                label[s + front] = s + seed
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def compare_buckets(buckets: DataFrame, radius: int, most: int) -> DataFrame:
    """Rows (mask, fp) with equal mask and fp & mask meet: links (kind 0, a, b) and,
    of buckets with more than ``most``, rows of the next level (kind 1, mask, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a, b) -> pa.RecordBatch:
            a, b = np.asarray(a), np.asarray(b)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["kind", "a", "b"],
            )

        def deeper(mask: np.uint64, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for piece in quarters(int(mask)):
                yield out(1, np.full(len(fps), int(mask) | piece, np.uint64), fps)

        def close(mask: np.ndarray, fps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            size = np.diff(np.r_[starts, len(fps)])
            large = (size > most) & [splits(m) for m in mask[starts]] if (size > most).any() else np.zeros(len(size), bool)
            for k in np.flatnonzero(large):
                yield from deeper(mask[starts[k]], fps[starts[k] : starts[k] + size[k]])
            take = np.repeat((size > 1) & ~large, size)
            kept = size[(size > 1) & ~large]
            if len(kept):
                yield out(0, *forest(fps[take], np.cumsum(kept) - kept, radius))

        held_mask, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        flowing = None  # mask and key of a bucket that is already too large
        for batch in batches:
            mask = np.concatenate([held_mask, batch.column(0).to_numpy().view(np.uint64)])
            fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(fps):
                continue
            key = fps & mask
            if flowing is not None:
                same = int(((mask == flowing[0]) & (key == flowing[1])).sum())
                yield from deeper(flowing[0], fps[:same])
                if same == len(fps):
                    held_mask, held = mask[:0], fps[:0]
                    continue
                mask, fps, key, flowing = mask[same:], fps[same:], key[same:], None
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            last = starts[-1]
            yield from close(mask[:last], fps[:last], starts[:-1])
            held_mask, held = mask[last:], fps[last:]
            if len(held) > most and splits(held_mask[0]):
                flowing = (held_mask[0], key[last])
                yield from deeper(flowing[0], held)
                held_mask, held = held_mask[:0], held[:0]
        if len(held):
            yield from close(held_mask, held, np.zeros(1, np.int64))

    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = buckets.withColumn("key", key).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.select("mask", "fp").mapInArrow(run, "kind int, a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within the radius.

    distinct: one column fp of distinct fingerprints.
    """
    masks = F.array(*[F.lit(signed(m)) for m in first_masks()])
    level = distinct.select(F.explode(masks).alias("mask"), "fp")
    edges = None
    while True:
        done = checkpoint(compare_buckets(level, radius, most))
        found = done.where("kind = 0").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        level = done.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("fp")).distinct()
        if not done.where("kind = 1").limit(1).count():
            return edges


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """marked (id, fp) checkpointed -> (fp, root, component_id), one row per distinct fp."""
    distinct = checkpoint(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(links(distinct.select("fp"), radius, most))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = checkpoint(rooted)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return checkpoint(named.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs."""
    marked = checkpoint(with_fingerprint(docs, id_col, text))
    named = classes(marked, id_col, radius).select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, hex16(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each class: the one with the least id (nulls last), of
    those the least fingerprint; repeated rows once.  Columns stay as they are."""
    schema, names = docs.schema, docs.columns
    at = names.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_ = f"c{names.index(id_col)}"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(texts) for _, _, texts in slices(batch.column(at), binary=True)]
            fps = np.concatenate(found or [np.zeros(0, np.uint64)])
            yield batch.append_column("fp", pa.array(fps.view(np.int64)))

    kinds = ", ".join(f"`c{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    marked = inner.mapInArrow(mark, f"{kinds}, fp long")
    ids = checkpoint(with_fingerprint(docs, id_col, text).withColumnRenamed(id_col, id_))
    named = classes(ids, id_, radius)
    pairs = ids.distinct().join(named.select("fp", "root"), "fp")
    first = pairs.groupBy("root").agg(F.min(F.struct(F.col(id_).isNull(), F.col(id_), F.col("fp"))).alias("k"))
    keep = first.select(F.col(f"k.{id_}").alias("keep_id"), F.col("k.fp").alias("keep_fp"))
    kept = marked.join(keep, F.col(id_).eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")), "left_semi")
    return one_row(kept, id_, "fp").drop("fp").toDF(*names)
