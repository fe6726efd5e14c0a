"""Versioned parquet tables with upsert, insert-if-absent, delete and cascade.

Spark's parquet tables have no MERGE: a merge is a full outer join written as a
new version folder; a pointer file then names the current version.  Readers of
the old version aren't disturbed, and a failed write leaves no trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

BETTER = ("composite_score", "score", "relevance_score")


def merge_items(stored: DataFrame, new: DataFrame) -> DataFrame:
    """K1: new rows (one for each url_hash) into stored ones.

    On conflict the three scores become the greater of both, only if one of the
    new is greater (null compares as unknown); all else stays.  ``action`` is
    inserted, updated or unchanged.
    """
    names = [c for c in stored.columns if c != "url_hash"]
    a = stored.select("url_hash", F.struct(*names).alias("old"))
    b = new.select("url_hash", F.struct(*names).alias("new"))
    both = a.join(b, "url_hash", "full_outer")
    better = F.lit(False)
    for c in BETTER:
        better = better | F.coalesce(F.col(f"new.{c}") > F.col(f"old.{c}"), F.lit(False))
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull() | ~better, "unchanged").otherwise("updated")
    marked = both.withColumn("action", action)

    def value(c: str) -> Column:
        kept = F.greatest(f"old.{c}", f"new.{c}") if c in BETTER else F.col(f"old.{c}")
        return F.when(F.col("action") == "inserted", F.col(f"new.{c}")).when(F.col("action") == "updated", kept).otherwise(F.col(f"old.{c}")).alias(c)

    return marked.select("url_hash", *[value(c) for c in names], "action")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K2, K3, K5, K8: rows of new whose keys aren't stored; of each key the first by ``ord``, without
    that column the least by a hash of the row, so reruns agree."""
    order = F.struct("ord", F.xxhash64(*new.columns)) if "ord" in new.columns else F.xxhash64(*new.columns)
    first = new.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*new.columns), order).alias("_row"))
    return first.select("_row.*").join(stored.select(*keys), keys, "left_anti").select(*new.columns)


def merge_briefing(stored: DataFrame, run: DataFrame) -> DataFrame:
    """K4: by date; total_items adds up, the counters of the run replace, sources are united
    and sorted (on the first insert as given)."""
    a, b = stored.alias("a"), run.alias("b")
    j = a.join(b, F.col("a.date") == F.col("b.date"), "full_outer")
    new = F.col("b.date").isNotNull()
    replaced = [
        F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        for c in ("items_extracted", "items_after_dedup", "items_filtered", "trending_count", "duration_seconds")
    ]
    sources = (
        F.when(F.col("a.date").isNull(), F.col("b.sources")).when(F.col("b.date").isNull(), F.col("a.sources"))
        .otherwise(F.array_sort(F.array_union("a.sources", "b.sources")))
    )
    total = F.coalesce("a.total_items", F.lit(0)) + F.coalesce("b.total_items", F.lit(0))
    return j.select(F.coalesce("a.date", "b.date").alias("date"), total.alias("total_items"), *replaced, sources.alias("sources"))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def remap(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """K14."""
    return df.replace(names, subset=[column])


def search_vector() -> Column:
    """The words of title, full text and source, as a generated column."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "full_text", "source")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def with_search_vector(items: DataFrame) -> DataFrame:
    """Items with the stored column ``search_vector``; rows that have one keep it.
    Write this once; searches then read the words instead of splitting whole texts each time."""
    stored = F.coalesce("search_vector", search_vector()) if "search_vector" in items.columns else search_vector()
    return items.withColumn("search_vector", stored)


def search_words(items: DataFrame) -> Column:
    """The stored words, or those made now of items that were stored without."""
    return F.col("search_vector") if "search_vector" in items.columns else search_vector()


def rescored(items: DataFrame, as_of: Column, only_missing: bool = False) -> DataFrame:
    """Live composite for all rows or for those without one."""
    live = S.composite(as_of)
    return items.withColumn("composite_score", F.coalesce("composite_score", live) if only_missing else live)


class VersionedTable:
    """A table at ``path``: folders v<n> of parquet and a pointer to the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.path))] if self.fs.exists(self._path(self.path)) else []
        done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self.fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, *partition_by: str) -> int:
        """The next version; it counts once its _SUCCESS file is there."""
        v = (self.version() or 0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v{v}")
        return v

    def upsert(self, new: DataFrame) -> int:
        """K1 on this table; how many rows were inserted or updated."""
        stored = self.read()
        if stored is None:
            stored = new.limit(0)
        seen = self.write(merge_items(stored.drop("action"), new.select([c for c in stored.columns if c != "action"])))
        return self.spark.read.parquet(f"{self.path}/v{seen}").where("action <> 'unchanged'").count()

    def delete(self, condition: Column) -> int:
        """Drop rows that meet the condition."""
        return self.write(self.read().where(~F.coalesce(condition, F.lit(False))))

    def truncate(self) -> int:
        return self.write(self.read().limit(0))

    def vacuum(self, keep: int = 2) -> None:
        last = self.version() or 0
        for s in self.fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= last - keep:
                self.fs.delete(s.getPath(), True)
