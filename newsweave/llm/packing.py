"""Mixture-controlled packing (operator 8): deficit round-robin over source queues.

Documents are tokenized once and dealt at random to groups of a bounded number
of tokens.  In a group every source has a queue.  Each window of ``window`` ids
credits each source with its share of the corpus; the sources are served in the
order of their deficits, each with a piece of at least ``least`` ids (or what
its document or the window has left), and what a source was given too much or
too little is carried to the next window.  A group begins with what the groups
before it owe (its share of all of them less what it got, by running sums over group
totals), so the deficits carry across partitions too.  Windows are always full; what is left at the end of a group is
cut into sequences whose lengths are powers of two, so that nothing is padded.

Null and empty texts are one id (the end mark).  Null ids stay null.  Null sources
are a source of their own.  Repeated rows are packed once each, ties in any order.
Columns other than id, text and source are not read, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WORD_PATTERN, ArrayBPE, normal_word
from .common import checkpoint, map_column

#: Pre-tokens that a worker's table may hold before it starts anew.
CACHE_ENTRIES = 400_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string"
)
NAMES = [field.split()[0] for field in PIECES.split(", ")]
#: Groups that a running sum is taken in at once, and groups of a task at most, about.
BLOCK, GROUPS_A_TASK = 4096, 32


class WordEncoder:
    """Ids of whole texts for a vocabulary that lower-cases and drops white space.

    Pre-tokens are found with array operations over the bytes of a batch and
    looked up in a table keyed by their bytes; those not in it yet are merged
    together and entered.  Texts with apostrophes, special strings or letters
    outside Latin go through the vocabulary's pattern one by one.
    """

    LATIN_ONLY = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ňŊ-ž]")
    BITS, KEYS = 21, 4
    SHORT = 8 * KEYS - 1  # longest pre-token that a key holds, its last byte being the length

    def __init__(self, path: str):
        self.bpe = ArrayBPE(path)
        self.dtype = np.uint16 if self.bpe.width <= 1 << 16 else np.uint32
        self.marks = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")")
        self.kind = np.full(256, 4, np.uint8)  # other
        self.kind[[*range(9, 14), 32]] = 0  # white space
        self.kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters
        self.kind[range(48, 58)] = 2  # digits, each a pre-token
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
        self.forget()

    def forget(self) -> None:
        self.long: dict[bytes, int] = {}
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.keys = np.zeros((0, self.KEYS), np.uint64)
        self.ids = np.zeros(0, self.dtype)
        self.ends = np.zeros(1, np.int64)

    def plain(self, text: str) -> bool:
        return "'" not in text and (text.isascii() or not self.LATIN_ONLY.search(text)) and not any(m in text for m in self.bpe.special)

    def enter(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merge new distinct pre-tokens; their numbers in the table of ids."""
        sym, n = self.bpe.merge_flat(data[spread(begin, size)], size)
        first = len(self.ends) - 1
        self.ids = np.concatenate([self.ids, sym.astype(self.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        return np.arange(first, first + len(n))

    def hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, self.KEYS):
            h = ((h >> np.uint64(29)) ^ h ^ keys[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(64 - self.BITS))).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each key or -1, and the slot where it is or would be."""
        slot = self.hash(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.slots[slot[open_]]
            open_, held = open_[held >= 0], held[held >= 0]
            same = (self.keys[held] == keys[open_]).all(axis=1)
            out[open_[same]] = held[same]
            open_ = open_[~same]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
        return out, slot

    def lookup(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each pre-token data[begin:begin+size]; data has 32 spare bytes."""
        if len(self.keys) + len(self.long) > CACHE_ENTRIES:
            self.forget()
        entry = np.full(len(begin), -1, np.int64)
        short = np.flatnonzero(size <= self.SHORT)
        words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 8,), (1,))
        at, n = begin[short], size[short]
        keys = np.stack([words[at + 8 * k] & self.masks[np.clip(n - 8 * k, 0, 8)] if k < 1 or (n > 8 * k).any() else np.zeros(len(n), np.uint64) for k in range(self.KEYS)], axis=1)
        keys[:, -1] |= n.astype(np.uint64) << np.uint64(56)
        found, _ = self.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = np.lexsort(keys[new].T)
            differ = np.r_[True, (keys[new[order[1:]]] != keys[new[order[:-1]]]).any(axis=1)]
            pick = new[order[differ]]
            number = self.enter(data, at[pick], n[pick])
            if len(self.keys) < number[0]:  # entries of long pre-tokens have no key
                self.keys = np.concatenate([self.keys, np.full((number[0] - len(self.keys), self.KEYS), 2**64 - 1, np.uint64)])
            self.keys = np.concatenate([self.keys, keys[pick]])
            todo = np.arange(len(pick))
            while len(todo):
                _, slot = self.find(keys[pick[todo]])
                one = np.unique(slot, return_index=True)[1]
                self.slots[slot[one]] = number[todo[one]]
                todo = np.delete(todo, one)
            back = np.empty(len(new), np.int64)
            back[order] = number[np.cumsum(differ) - 1]
            found[new] = back
        entry[short] = found
        rest = np.flatnonzero(size > self.SHORT)
        if len(rest):
            tokens = [data[b : b + k].tobytes() for b, k in zip(begin[rest], size[rest])]
            fresh = {t: i for i, t in enumerate(tokens) if t not in self.long}
            if fresh:
                pos = rest[list(fresh.values())]
                self.long.update(zip(fresh, self.enter(data, begin[pos], size[pos]).tolist()))
            entry[rest] = [self.long[t] for t in tokens]
        return entry

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the pre-tokens of lower-case Latin text."""
        kind = self.kind[data]
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        digit = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 2)) + 1
        edges = np.unique(np.r_[0, change, digit, len(data)]) if len(digit) else np.r_[0, change, len(data)]
        begin, size = edges[:-1], np.diff(edges)
        keep = (kind[begin] != 0) & (size > 0)
        return begin[keep], size[keep]

    def odd(self, text: str) -> list:
        """Pre-tokens (bytes) and special ids of any text, by the vocabulary's pattern."""
        out: list = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append(self.bpe.special[part])
            else:
                out += [t.encode() for t in WORD_PATTERN.findall(normal_word(part))]
        return out

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each followed by ``end``, and how many each has."""
        parts, begin, size, owner, special, at = [], [], [], [], [], 0
        for i, text in enumerate(texts):
            if self.plain(text):
                raw = text.lower().encode()
                b, n = self.cut(np.frombuffer(raw, np.uint8)) if raw else (np.zeros(0, np.int64),) * 2
                parts.append(raw)
                begin.append(b + at)
                at += len(raw)
            else:
                tokens = self.odd(text)
                n = np.array([0 if isinstance(t, int) else len(t) for t in tokens], np.int64)
                raw = b"".join(t for t in tokens if not isinstance(t, int))
                parts.append(raw)
                begin.append(np.where(n > 0, at + np.cumsum(n) - n, -1 - np.array([t if isinstance(t, int) else 0 for t in tokens], np.int64)))
                at += len(raw)
            size.append(n)
            owner.append(len(n))
        data = np.frombuffer(b"".join(parts) + bytes(8 * self.KEYS + 8), np.uint8)
        begin, size, owner = np.concatenate(begin), np.concatenate(size), np.array(owner, np.int64)
        mark = np.flatnonzero(size == 0)
        if len(mark):
            real = size > 0
            entry = np.zeros(len(size), np.int64)
            entry[real] = self.lookup(data, begin[real], size[real])
        else:
            entry = self.lookup(data, begin, size)
        start, n_ids = self.ends[entry], self.ends[entry + 1] - self.ends[entry]
        n_ids[mark] = 1
        source = self.ids
        if len(mark):
            start[mark] = len(source) + np.arange(len(mark))
            source = np.concatenate([source, (-1 - begin[mark]).astype(self.dtype)])
        sums, upto = np.r_[0, np.cumsum(n_ids)], np.cumsum(owner)
        n = sums[upto] - sums[upto - owner]
        flat = source[spread(start, n_ids)]
        if end is not None:
            flat = np.insert(flat, np.cumsum(n), end)
            n = n + 1
        return flat, n


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] of them), begin[1], ..."""
    keep = size > 0
    begin, size = begin[keep], size[keep]
    if not len(size):
        return np.zeros(0, np.int64)
    step = np.ones(int(size.sum()), np.int64)
    step[0] = begin[0]
    step[np.cumsum(size)[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(step)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def tokenize(docs: DataFrame, path: str, end: int, id_col: str, text: str, source: str) -> DataFrame:
    """id, source, n and the ids of each row's whole text as little-endian binary."""

    def make():
        enc = encoder(path)

        def work(texts: list[str]) -> dict:
            flat, n = enc.encode(texts, end)
            width = flat.itemsize
            offsets = pa.array(np.r_[0, np.cumsum(n) * width], pa.int64())
            ids = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())]
            ).cast(pa.binary())
            return {"n": pa.array(n), "ids": ids}

        return work

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), text)
    return map_column(named, make, "n long, ids binary", text, ("doc_id", "source"))


def serve(
    sizes: np.ndarray, queue: np.ndarray, deficit: np.ndarray, share: np.ndarray, window: int, least: int
) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group.

    sizes: ids of each document; queue: its source's number, documents in serving
    order; deficit and share: by source, in ids and as a fraction.
    """
    waiting = [list(np.flatnonzero(queue == s))[::-1] for s in range(len(share))]
    given = [0] * len(share)
    deficit, credit = deficit.astype(float).tolist(), (share * window).tolist()
    left, seq = int(sizes.sum()), 0
    live = [s for s in range(len(share)) if waiting[s]]
    sizes = sizes.tolist()
    ends: list[int] = []
    while left:
        if left < window and not ends:
            ends = [1 << b for b in range(left.bit_length()) if left >> b & 1]
        room = ends.pop() if ends else window
        left -= room
        for s in live:
            deficit[s] += credit[s] * room / window
        offset = 0
        while offset < room:
            s = max(live, key=deficit.__getitem__)
            doc = waiting[s][-1]
            take = min(sizes[doc] - given[s], room - offset, max(int(deficit[s]), least))
            yield doc, given[s], take, seq, offset
            offset += take
            given[s] += take
            deficit[s] -= take
            if given[s] == sizes[doc]:
                waiting[s].pop()
                given[s] = 0
                if not waiting[s]:
                    live.remove(s)
        seq += 1


def place(dealt: DataFrame, total: int) -> DataFrame:
    """dealt (part, source, n) -> by part and source: share, owed.

    A source is owed its share of all groups before this one, less what it got in
    them.  Running sums are taken in blocks of ``BLOCK`` groups and then inside each
    block, so no task orders all groups of a source.
    """
    by = checkpoint(
        dealt.groupBy("part", "source").agg(F.sum("n").alias("n")).withColumn("block", (F.col("part") / BLOCK).cast("long"))
    )

    def before(keys: list, order: str) -> Column:
        over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(over), F.lit(0))

    def running(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Sum of n over the parts before, by keys."""
        blocks = df.groupBy(*keys, "block").agg(F.sum("n").alias("n")).withColumn("earlier", before(keys or [F.lit(0)], "block"))
        blocks = blocks.select(*[F.col(k).alias(f"b_{k}") for k in [*keys, "block"]], "earlier")
        inside = df.withColumn("inside", before([*keys, "block"], "part"))
        same = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in [*keys, "block"]]
        return inside.join(blocks, reduce(Column.__and__, same)).select("part", *keys, (F.col("inside") + F.col("earlier")).alias(name))

    parts = running(by.groupBy("part", "block").agg(F.sum("n").alias("n")), [], "all_before")
    own = running(by, ["source"], "own_before")
    shares = by.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("share")).withColumnRenamed("source", "s")
    return own.join(parts, "part").join(shares, F.col("source").eqNullSafe(F.col("s"))).select(
        "part", "source", "share", (F.col("all_before") * F.col("share") - F.col("own_before")).alias("owed")
    )


def fill(rows: list[pa.Array], plan: list[tuple], part: int, window: int, least: int, width: int) -> pa.RecordBatch:
    """Pieces of one group: rows (source, doc_id, n, ids) in serving order, plan (source, share, owed)."""
    source, doc_id, n, ids = rows
    code = {s: i for i, (s, _, _) in enumerate(plan)}
    queue = np.array([code[s] for s in source.to_pylist()], np.int64)
    sizes = n.to_numpy()
    share, owed = (np.array([p[k] for p in plan], float) for k in (1, 2))
    doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*serve(sizes, queue, owed, share, window, least)))
    crc, last, data = np.empty(len(doc), np.int64), -1, b""
    for k in np.argsort(doc, kind="stable"):  # one text's ids at a time
        if doc[k] != last:
            last = doc[k]
            data = np.frombuffer(ids[last].as_buffer(), f"<u{width}").astype("<u4").tobytes()
        crc[k] = zlib.crc32(data[4 * start[k] : 4 * (start[k] + length[k])])
    at = pa.array(doc)
    columns = [doc_id.take(at), start, length, crc, sizes[doc], (part << 32) + seq, offset, source.take(at)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=NAMES)


def pack(
    docs: DataFrame, path: str, end: int = 1, window: int = 2048, least: int = 256,
    group_tokens: int = 1_000_000, id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    # the place of a row parts rows that are repeated very often
    h = F.xxhash64("doc_id", "ids", F.monotonically_increasing_id()).alias("h")
    tokens = checkpoint(tokenize(docs, path, end, id_col, text, source).select("source", "doc_id", "n", "ids", h))
    # bytes of an id as the tasks wrote it: the driver loads no vocabulary
    total, width = (x or 0 for x in tokens.agg(F.sum("n"), F.max(F.expr("octet_length(ids) div n"))).first())
    groups = max(1, -(-total // group_tokens))
    dealt = tokens.select(F.pmod("h", F.lit(groups)).alias("part"), "source", "doc_id", "n", "ids")
    plan = place(dealt, total)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("share", "double"), ("owed", "double"))]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n", "long"), ("ids", "binary"))]
    # a group's plan comes before its rows
    rows = plan.select("part", "source", "share", "owed", *empty).unionByName(dealt.select("part", "source", *none, "doc_id", "n", "ids"))
    tasks = max(-(-groups // GROUPS_A_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(tasks, "part").sortWithinPartitions("part", F.col("n").isNotNull(), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_plan, held = None, [], []

        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            return fill([whole.column(c).combine_chunks() for c in ("source", "doc_id", "n", "ids")], now_plan, now, window, least, width)

        for batch in batches:
            parts = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(parts)]):
                if parts[a] != now:
                    if held:
                        yield close()
                    now, now_plan, held = int(parts[a]), [], []
                piece = batch.slice(a, b - a)
                heads = piece.column(4).null_count
                if heads:
                    now_plan += zip(*(piece.column(k).slice(0, heads).to_pylist() for k in (1, 2, 3)))
                if heads < len(piece):
                    own = piece.slice(heads).select([1, 4, 5, 6])
                    # a copy: a slice would hold on to the whole batch
                    held.append(own.take(pa.array(np.arange(len(own)))))
        if held:
            yield close()
        pa.default_memory_pool().release_unused()

    return ordered.select("part", "source", "share", "owed", "n", "doc_id", "ids").mapInArrow(run, PIECES)
