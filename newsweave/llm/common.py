"""Helpers shared by the operators: table reading, checkpoints, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in chunks of about so many bytes, which bounds what a task
#: holds besides the Arrow batch itself.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset
    and driver and executors are one process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="newsweave-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: for many rows with repeated values, which a
    checkpoint would hold as they are."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_col(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: as of empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, seed: int, rows: int, most_bytes: int, id_col: str, text: str,
    modulus: int, held_out: int, extra: Sequence[Column] = (),
) -> DataFrame:
    """(id, label, text, *extra) of labelled rows whose crc32(id) mod ``modulus`` isn't ``held_out``.

    At most ``rows`` ids, the first by a seeded hash, and of these as many as have
    ``most_bytes`` of text together, one at least.  An id labelled twice has its larger
    label; of rows with the same id the one with the least text is taken.
    """
    place = F.xxhash64(F.lit(seed), F.col(id_col))
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, modulus) != held_out))
        .groupBy(F.col(id_col).alias("id"), place.alias("place")).agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy("place", "id").limit(rows)
    )
    found = docs.select(F.col(id_col).alias("id"), F.struct(text_col(text).alias("text"), *extra).alias("row"))
    found = checkpoint(found.join(F.broadcast(chosen), "id").groupBy("place", "id", "label").agg(F.min("row").alias("row")))
    upto, last = 0, None
    for place, size in found.select("place", F.octet_length("row.text")).orderBy("place").collect():  # ``rows`` at most
        upto += size
        if last is not None and upto > most_bytes:
            break
        last = place
    return found.where(F.lit(last is not None) & (F.col("place") <= F.lit(last or 0))).select("id", "label", "row.*")


def one_row(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the same whatever the order: the one with the least hash."""
    names = df.columns
    return df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")


def slices(column: pa.Array, binary: bool = False, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list]]:
    """Ranges of a text column of about ``limit`` bytes each, at least one row, with their
    values (null as empty); only one range is held as Python objects at a time."""
    if binary:
        column = column.cast(pa.binary())
    column = pc.fill_null(column, b"" if binary else "")
    upto = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    a = 0
    while a < len(column):
        before = upto[a - 1] if a else 0
        b = min(int(np.searchsorted(upto, before + limit)) + 1, len(column))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def map_column(
    df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, column: str = "text",
    keep: tuple[str, ...] = ("doc_id",), binary: bool = False,
) -> DataFrame:
    """Map one text column through Arrow batches; ``keep`` columns go along.

    ``make()`` runs once per task and returns a function from a list of texts
    (or UTF-8 bytes) to a dict of output columns.  Null texts arrive empty.
    """
    source = df.select(*keep, text_col(column).alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for a, b, texts in slices(batch.column(len(keep)), binary):
                out = work(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                    + [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()],
                    names=[*keep, *out],
                )
        pa.default_memory_pool().release_unused()  # workers live on for the next stage

    return source.mapInArrow(run, ", ".join([*kept, schema]))
