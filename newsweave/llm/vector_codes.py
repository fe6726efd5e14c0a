"""Codes of vectors, four parts of 256 codebook entries each (operator 13), all in integers.

The kept vectors are cut into four parts.  Each position's parts are put in the order of a
Hilbert curve by a range shuffle and stored as flat blocks of 128, each with the box of its
components (least and greatest) and their sums.  In every round a block takes as its shortlist
the entries whose nearest point of the box isn't beyond the farthest point of another entry; a
shortlist of one takes the block's sums as they are, others are evaluated part by part by an
exact kernel.  Tasks hand on sums by entry, so a round moves at most 1,024 rows a task, and the
driver holds the codebooks only.  The range shuffle orders by position, curve and row, so equal
vectors are split over tasks like others.

Rows whose vector is null or holds a null or non-finite component are left out.  Vectors of
unequal length are filled up with zeros to the longest length, and that to a multiple of four
(one component a part at least).  Null ids come last in the order that starts the codebooks, rows
of one id in the order of their components; each row, repeated ones too, is coded and counts in
the sums.  Fewer than 256 kept rows give fewer entries.  Null labels are one label.  Other columns
are left out, so clashing names don't matter.  An empty table gives no rows.  Components of 2^17 or
more raise ValueError, as distances of such vectors needn't fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts in a block; bits of each component in the curve.
BLOCK, BITS = 128, 4
#: Integer components stay below, so 4 * width * LARGEST ** 2 < 2 ** 63 for any width up to 128.
LARGEST = 1 << 27
#: Up to so many labels (one short row each) their sums are broadcast.
BROADCAST_LABELS = 100_000

BLOCKS = "pos int, rids binary, parts binary, least binary, most binary, sums binary"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve, one row of bytes for each row of ``cells`` (unsigned, below
    2^bits), most significant first (the transform of Skilling, 2004)."""
    x = cells.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(x.shape[1]):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, x.shape[1]):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
    x ^= turn[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1
    return np.packbits(planes.reshape(len(x), -1).astype(np.uint8), axis=1)


def shortlist(least: np.ndarray, most: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be the nearest of some point of the box, ascending."""
    below, above = least - book, book - most
    near = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    far = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all parts to all entries, exact."""
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact_in_doubles = 4 * parts.shape[1] * largest**2 < 1 << 53
    x, c = (parts.astype(np.float64), book.astype(np.float64)) if exact_in_doubles else (parts, book)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def nearest(parts: np.ndarray, among: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each part; ties go to the lower entry."""
    found = distances(parts, book[among])
    best = found.argmin(axis=1)
    return among[best], found[np.arange(len(parts)), best]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _with_keys(least: int, most: int, depth: int):
    """Adds the place of each part on its curve; ``least`` and ``most`` bound the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _column(batch, "part").flatten().to_numpy().reshape(-1, depth)
            cells = np.clip((parts - least) * (1 << BITS) // (most - least + 1), 0, (1 << BITS) - 1)
            keys = hilbert_keys(cells)
            columns = {n: _column(batch, n) for n in ("rid", "pos", "part")}
            yield pa.RecordBatch.from_pydict({**columns, "key": pa.array([k.tobytes() for k in keys], pa.binary())})

    return run


def _blocks(depth: int):
    """Cuts sorted parts into flat blocks; a batch's blocks don't reach into the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, rids = (_column(batch, n).to_numpy() for n in ("pos", "rid"))
            parts = _column(batch, "part").flatten().to_numpy().reshape(-1, depth)
            bounds = [0, *(np.flatnonzero(np.diff(pos)) + 1), len(pos)]
            out = []
            for a, z in zip(bounds, bounds[1:], strict=False):
                for i in range(a, z, BLOCK):
                    own = parts[i : min(i + BLOCK, z)]
                    stored = (rids[i : min(i + BLOCK, z)], own.astype(np.int32), own.min(axis=0), own.max(axis=0), own.sum(axis=0))
                    out.append((int(pos[i]), *(np.ascontiguousarray(x).tobytes() for x in stored)))
            names = ["pos", "rids", "parts", "least", "most", "sums"]
            kinds = [pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names=names)

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(pos, rids, parts, least, most, sums) of each block."""
    for batch in batches:
        for row in zip(*[_column(batch, n).to_pylist() for n in ("pos", "rids", "parts", "least", "most", "sums")], strict=True):
            least, most, sums = (np.frombuffer(x, np.int64) for x in row[3:])
            yield row[0], np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.int32).astype(np.int64).reshape(-1, len(sums)), least, most, sums


def entry_sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pos, entry, n, sums) over all blocks of a task, for entries that have parts."""
    n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for pos, rids, parts, least, most, sums in _each(batches):
        among = shortlist(least, most, books[pos])
        if len(among) == 1:
            n[pos, among[0]] += len(rids)
            total[pos, among[0]] += sums
        else:
            to, _ = nearest(parts, among, books[pos])
            np.add.at(n[pos], to, 1)
            np.add.at(total[pos], to, parts)
    used = np.argwhere(n)
    yield pa.RecordBatch.from_pydict({
        "pos": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()), "n": pa.array([int(n[p, k]) for p, k in used], pa.int64()),
        "sums": pa.array([total[p, k].tolist() for p, k in used], pa.list_(pa.int64())),
    })


def part_codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(rid, pos, entry, error) of each part."""
    for pos, rids, parts, least, most, _ in _each(batches):
        to, error = nearest(parts, shortlist(least, most, books[pos]), books[pos])
        yield pa.RecordBatch.from_pydict({
            "rid": pa.array(rids), "pos": pa.array(np.full(len(rids), pos, np.int32)), "entry": pa.array(to.astype(np.int32)), "error": pa.array(error),
        })


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each used entry becomes the floor of its parts' mean."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    partial = blocks.mapInArrow(lambda batches: entry_sums(batches, shared.value), "pos int, entry int, n bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]
    after = books.copy()
    for row in partial.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # as many rows as entries at most
        after[row[0], row[1]] = [s // row[2] for s in row[3:]]
    return after


def kept(df: DataFrame, vector: str) -> Column:
    """Whether the vector is whole and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def codes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each kept row of ``df``."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    base = checkpoint(
        df.where(kept(df, vector))
        .select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(label).alias("label"), whole.alias("v"))
    )
    longest, least, most = base.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if max(-(least or 0), most or 0) >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more")
    depth = max(1, -(-(longest or 0) // PARTS))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * depth) - F.size("v"))).alias("v")
    rows = base.select("rid", "id", filled)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()  # the codebooks, a fixed number of rows
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, depth).transpose(1, 0, 2).copy()
    low, high = int(books.min(initial=0)), int(books.max(initial=0))

    parts = rows.select("rid", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("v", p * depth + 1, depth).alias("part")) for p in range(PARTS)])).alias("p"))
    keyed = parts.select("rid", "p.pos", "p.part").mapInArrow(_with_keys(low, high, depth), "rid bigint, pos int, part array<bigint>, key binary")
    on_curve = keyed.repartitionByRange("pos", "key", "rid").sortWithinPartitions("pos", "key", "rid")
    blocks = checkpoint(on_curve.mapInArrow(_blocks(depth), BLOCKS))
    if first:
        for _ in range(ROUNDS):
            books = refine(blocks, books)
    sha = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()

    shared = df.sparkSession.sparkContext.broadcast(books)
    coded = blocks.mapInArrow(lambda batches: part_codes(batches, shared.value), "rid bigint, pos int, entry int, error bigint")
    names = base.select("rid", F.struct("id", "label").alias("own"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("entry"), F.lit(0).cast("long").alias("error"))
    both = coded.withColumn("own", F.lit(None).cast(names.schema["own"].dataType)).unionByName(names)
    hexed = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("entry"))))), 2, "0") for p in range(PARTS)]
    out = checkpoint(
        both.groupBy("rid").agg(F.first("own", ignorenulls=True).alias("own"), F.concat(*hexed).alias("code"), F.sum("error").alias("error"))
        .select("own.*", "code", "error")
    )
    by_label = checkpoint(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )


def _rounds() -> str:
    """The rounds of the contract as common table expressions."""
    near = """a{k} AS MATERIALIZED (
  SELECT rid, p, arg_min(e, d) AS e, min(d) AS d FROM (
    SELECT x.rid, x.p, c.e, ((list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, c.x) + list_dot_product(c.x, c.x))::BIGINT * 256 + c.e) AS d
    FROM parts x JOIN c{k} c ON x.p = c.p) GROUP BY rid, p)"""
    step = """s{n} AS (
  SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT a.p, a.e, unnest(x.x)::BIGINT AS x, generate_subscripts(x.x, 1) AS j FROM a{k} a JOIN parts x ON a.rid = x.rid AND a.p = x.p)
  GROUP BY p, e, j),
m{n} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS x FROM s{n} GROUP BY p, e),
c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{n} m ON c.p = m.p AND c.e = m.e)"""
    out = []
    for k in range(ROUNDS):
        out += [near.format(k=k), step.format(k=k, n=k + 1)]
    return ",\n".join([*out, near.format(k=ROUNDS)])


#: The contract in DuckDB, each round spelt out.
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, rid AS e, x FROM parts WHERE rid < 256),
{_rounds()},
coded AS (
  SELECT kept.rid, vec_id, label, string_agg(lower(lpad(to_hex(a.e), 2, '0')), '' ORDER BY a.p) AS code, sum(a.d // 256)::BIGINT AS error
  FROM kept JOIN a{ROUNDS} a ON kept.rid = a.rid GROUP BY kept.rid, vec_id, label),
books AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, list_aggregate(list_transform(x, lambda y: y::BIGINT), 'string_agg', ',') AS t FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
