"""Connected components of a link table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(links: DataFrame) -> DataFrame:
    """(a bigint, b bigint) links -> (node, root), one row per node that has a link; root is the same for all that are
    connected and is itself one of them.

    Each round sends every node to the neighbour (or itself) that comes first in an order drawn anew for the round, and
    replaces links by the links of the chosen nodes. Chains shrink by a constant factor a round whatever their order, so
    rounds grow with the logarithm of the longest chain. Minima are aggregated before the shuffle, so a star's centre
    is no hot key; the joins are equi-joins that adaptive execution may split. Nulls and self-links are dropped.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    chosen, step = None, 0
    while not links.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        both = links.select(F.col("a").alias("node"), F.least(order("a"), order("b")).alias("best")).union(
            links.select(F.col("b"), F.least(order("a"), order("b")))
        )
        moved = cut(both.groupBy("node").agg(F.min("best").alias("best")).select("node", F.col("best.n").alias("root")))
        if chosen is None:
            chosen = moved
        else:
            later = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            chosen = cut(chosen.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        to = moved.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        links = links.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        links = cut(links.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        step += 1
    if chosen is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return chosen
