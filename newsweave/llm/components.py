"""Connected components over an edge table, as Spark joins and aggregates.

Each round is one large-star and one small-star step (Kiveris et al., 2014):
every node learns the smallest node next to it, and edges are hung onto it,
until nothing changes.  The smallest-neighbour table is broadcast only while
its checked size is below ``broadcast_rows``; beyond that it is joined by
shuffle, from checkpoints, so that adaptive execution can split hot keys.

Every task and job leaves a record on the driver.  So while twice the edges, which
bound that table, are below ``broadcast_rows``, a step neither stores nor counts the table,
and its rows are in as few tasks as they need, whatever the number of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

BROADCAST_ROWS = 500_000
#: Arcs of a task at least, about, where there are more of them than cores take at once.
ARCS_A_TASK = 50_000


def _step(arcs: DataFrame, emit: str, few: bool, broadcast_rows: int) -> DataFrame:
    """arcs (x, y) joined with the least of x and its y's; emit: rows wanted.  few: it is known
    that the arcs are no more than ``broadcast_rows``."""
    least = arcs.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    if not few:
        least = checkpoint(least)
    if few or least.count() <= broadcast_rows:
        least = F.broadcast(least)
    joined = arcs.join(least, "x")
    if emit == "large":
        pairs = joined.where("y > x and y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    else:
        own = joined.where("x != m").select("x", F.col("m").alias("y"))
        pairs = joined.where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(own)
    return pairs.distinct()


def connected_components(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the least node of its component.

    Self loops and repeated edges are allowed; a node that has only such loops has no
    row.  Edges with a null end are left out.  Nodes are of any ordered type.  Without
    edges there are no rows.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = checkpoint(edges.where("a != b").select(big.alias("x"), small.alias("y")).distinct())
    seen = None
    while True:  # ends: each round that changes the edges brings nodes nearer to their roots
        state = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        arcs = 2 * state[0]  # no step has more
        few = arcs <= broadcast_rows
        tasks = max(now.sparkSession.sparkContext.defaultParallelism, -(-arcs // ARCS_A_TASK))

        def dealt(df: DataFrame) -> DataFrame:
            return df.coalesce(tasks) if few else df

        large = checkpoint(dealt(_step(dealt(both), "large", few, broadcast_rows)))
        now = checkpoint(dealt(_step(large, "small", few, broadcast_rows)))
    nodes = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    roots = now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return nodes.unionByName(roots)
