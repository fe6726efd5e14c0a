"""A training corpus from raw documents, in five stages.

Toxic documents go, one document of each near-duplicate class stays, secrets are
replaced in the texts, sources are mixed to target weights (documents are
repeated or left out), and what is left is packed into sequences.  Every stage
is a function of (spark, docs, sf_dir); run() writes each result as Parquet in
the shared folder and reads it back for the next, after which it is removed.  The
stages before the last return the columns of ``documents``.

Null texts pass as empty ones and stay null until they are packed; null sources are
a source, null ids stay.  Empty, very long and repeated texts, clashing extra columns
and empty tables go through every stage as its operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsweave.llm import mixing, near_copies, packing, secret_scan, toxicity
from newsweave.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express the classifier, SimHash and the tokenizer.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read:
            remove(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return docs
