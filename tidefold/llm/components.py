"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import settled


def _pulled(pairs: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours of every node with the smallest of them.

    ``keep`` names the neighbours that are linked anew: ``larger`` ones than
    the node, over links in both directions, or all ``smaller`` ones.
    """
    if keep == "larger":
        sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = pairs
    least = sides.groupBy("a").agg(F.min("b").alias("least"))
    if keep == "larger":
        least = least.withColumn("least", F.least("a", "least"))
        linked = sides.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), "least")
    else:
        linked = sides.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), "least")
        linked = linked.unionByName(least)
    return linked.select("a", F.col("least").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """The smallest id reachable from every linked id: columns ``id`` and ``root``.

    ``pairs`` has long columns ``a`` and ``b``.  Two steps alternate until
    nothing changes: every node hands its larger neighbours, then its smaller
    ones, to the smallest neighbour.  A node's neighbours meet in a minimum and
    a join, never in one list, so a hub with millions of links is split like
    any other skewed join.  Lineage is cut in the shared folder each round.

    An empty table gives no rows; self links and repeated pairs do no harm;
    pairs with a NULL end are ignored.
    """
    pairs = pairs.filter(F.col("a") != F.col("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current, before = settled(pairs.distinct()), None
    while True:
        mark = current.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return current.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = mark
        current = settled(_pulled(_pulled(current, "larger"), "smaller"))
