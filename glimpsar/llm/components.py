"""Connected components of an undirected graph given as a table of edges.

Alternates the large-star and small-star steps of Kiveris et al. ("Connected Components in MapReduce
and Beyond"), which need a logarithmic number of rounds for trees and few in practice.  Every round is
written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over ``pairs`` (u, v).

    The smallest neighbour of each node comes from a pre-aggregated minimum; it is joined back to the
    node's pairs, so no node's neighbours are ever gathered in one place.
    """
    if large:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        keep = F.col("v") > F.col("u")
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        keep = F.lit(True)
    # Stored, so that the join below is of two plain shuffles, and the pairs of a hub can be split among tasks.
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low")
    linked = both.join(low, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(low.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    ``edges`` has two columns of longs.  Nulls, loops, repeated and reversed edges are harmless.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs = stored(pairs, "components")
    for _ in range(max_rounds):
        after = stored(_star(_star(pairs, True), False), "components")
        same = after.count() == pairs.count() and after.join(pairs, ["u", "v"], "left_anti").isEmpty()
        pairs = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
