"""A table of items in buckets of url_hash, into which batches are merged.

Rows lie in folders ``bucket=<n>`` by the first digits of url_hash.  A batch reads and writes only the
buckets that it has rows for (dynamic partition overwrite); files of the others stay as they are.  A
batch is known by its id: once its mark is written it isn't merged again, and merging again what
was half written gives the same rows, as the better scores are kept.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import cut, least_by
from .store import merge_items

DIGITS = 2


class BucketedTable:
    """``digits`` hexadecimal digits give 16 to that power buckets."""

    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.conv(F.substring("url_hash", 1, self.digits), 16, 10).cast("int")

    def exists(self) -> bool:
        return self.fs.exists(self._paths(f"{self.path}/rows"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("bucket")

    def done(self, batch: str) -> bool:
        return self.fs.exists(self._paths(f"{self.path}/batches/{batch}"))

    def upsert(self, new: DataFrame, batch: str | None = None) -> DataFrame | None:
        """Merge rows (with url_hash; null ones are left out); of one url_hash the best score counts.  Returns the
        rows of the touched buckets with their ``action``, or None for a batch that is done."""
        if batch is not None and self.done(batch):
            return None
        keyed = new.where("url_hash is not null")
        order = F.struct(-F.coalesce("score", F.lit(0)), F.xxhash64(*new.columns))
        once = cut(least_by(keyed, ["url_hash"], order).withColumn("bucket", self.bucket()))
        touched = [r["bucket"] for r in once.select("bucket").distinct().collect()]  # as many as there are buckets at most
        merged = None
        if touched:
            if self.exists():
                stored = self.spark.read.parquet(f"{self.path}/rows").where(F.col("bucket").isin(touched)).drop("bucket")
            else:
                stored = once.drop("bucket").limit(0)
            merged = cut(merge_items(stored, once.drop("bucket")))
            placed = merged.drop("action").withColumn("bucket", self.bucket()).repartition("bucket")
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        if batch is not None:
            self.fs.create(self._paths(f"{self.path}/batches/{batch}"), True).close()
        return merged
