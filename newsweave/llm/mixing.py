"""Mixing sources to target weights by capped water-filling (operator 7), all in
DataFrame functions.

Each source is to give weight-proportional words of ``budget`` times all words,
at most ``epochs`` times its own.  Sources that would exceed their cap are
clamped and the excess goes to the others by weight until none is above; sorted
by cap over weight, that fixed point is one running sum.  A document is repeated
the whole number of epochs; the fractional epoch takes documents in the order of
a seeded hash until the words are used up, and of the document at the cut the part that is
still wanted, so a source's sum misses its target by less than a word a document
at the cut.  mix() repeats whole documents only, and rounds that part.  The cut in that order is found in two levels (4,096
hash ranges, then rows of the one range that holds the cut), so no task orders a
whole source.

Null texts have size 0.  Null sources are one source, last in order.  Null ids
hash as empty text.  Repeated rows hash alike and are taken together.  A source
without words has target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, text_col

#: Up to so many sources (one short row each) the plan by source is broadcast.
BROADCAST_SOURCES = 100_000


def words(text: str = "text") -> Column:
    """Number of words, from the runs of white space: a blank put in front makes
    every word follow one run; a run at the end is followed by none."""
    trimmed = F.rtrim(text_col(text), F.lit(" \t\n\x0b\f\r"))
    runs = F.size(F.split(F.concat(F.lit(" "), trimmed), "[\\x20\\x09-\\x0D]+")) - 1
    return F.when(trimmed == "", 0).otherwise(runs).cast("long")


def order_key(id_col: str, seed: int) -> Column:
    """Seeded place of a document, 0 to 2^60 - 1, from the md5 of seed and id."""
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, epochs: float) -> DataFrame:
    """sizes (source, source_size) -> also weight, target, by capped water-filling."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("r", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("r", F.col("cap") / F.col("weight"))
        .withColumn("lambda", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source whose cap is above the level sets the level of all after it
        .withColumn("level", F.first(F.when(F.col("lambda") <= F.col("r"), F.col("lambda")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return filled.select("source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source, null with null; ``right`` has one row a source."""
    other = right.withColumnRenamed("source", "__s")
    return left.join(other, left["source"].eqNullSafe(other["__s"]), how).drop("__s")


def plan(base: DataFrame, weights: Sequence[float], budget: float, epochs: float) -> DataFrame:
    """base (source, size, h) -> by source: source_size, target, whole, cut, tied, part.

    A document is taken ``whole`` times and once more if its h is below ``cut``; those
    at the cut (``tied`` words) give ``part`` words."""
    ranged = base.withColumn("bin", F.shiftright("h", 48).cast("int"))
    bins = checkpoint(ranged.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    filled = targets(sizes, weights, budget, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = checkpoint(
        filled.withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = same_source(bins.withColumn("upto", F.sum("bin_size").over(upto)), wanted)
    # the first range that the rest doesn't cover holds the cut
    edge = placed.where("upto > rest").groupBy("source").agg(
        F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("bin_size")).alias("room"))).alias("e")
    )
    edges = edge.select("source", F.col("e.bin").alias("edge"), F.col("e.room").alias("room"))
    few = wanted.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    inside = same_source(ranged, hint(edges)).where("bin = edge").groupBy("source", "h", "room").agg(F.sum("size").alias("tied"))
    running = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        inside.withColumn("upto", F.sum("tied").over(running)).where("upto > room")
        .groupBy("source").agg(F.min(F.struct("h", "tied", (F.col("room") - F.col("upto") + F.col("tied")).cast("long").alias("part"))).alias("x"))
        .select("source", F.col("x.h").alias("cut"), F.col("x.tied").alias("tied"), F.col("x.part").alias("part"))
    )
    # no crossing: the last epoch is whole or empty
    out = checkpoint(same_source(wanted, crossing, "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), "tied", "part"))
    return F.broadcast(out) if few else out


def taken() -> Column:
    """Words taken of a document: whole epochs, and of the fractional one all before
    the cut and the remaining part at the cut."""
    last = F.when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), F.expr("size * part div tied")).otherwise(0)
    return F.col("size") * F.col("whole") + last


def copies() -> Column:
    """Whole copies of a document: the one at the cut is taken if at least half of it would be."""
    return F.col("whole") + F.when((F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & (2 * F.col("part") >= F.col("tied")), 1).otherwise(0)


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs."""
    base = checkpoint(
        docs.select(
            F.col(id_col), F.col(source).cast("string").alias("source"), words(text).alias("size"),
            order_key(id_col, seed).alias("h"),
        )
    )
    joined = same_source(base, plan(base.select("source", "size", "h"), weights, budget, epochs))
    return joined.select(id_col, "size", "source_size", "target", taken().alias("taken"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, epochs: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns stay as they are."""
    names = docs.columns
    base = checkpoint(
        docs.select(F.col(source).cast("string").alias("source"), words(text).alias("size"), order_key(id_col, seed).alias("h"))
    )
    by_source = plan(base, weights, budget, epochs)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(source).cast("string").alias("source"), order_key(id_col, seed).alias("h"),
    )
    taken = same_source(keyed, by_source).withColumn("copies", copies().cast("int")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
