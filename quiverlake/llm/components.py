"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with a link to another; all nodes of a component share one root.

    A round lets each node point to its smallest neighbour, if smaller, follows the pointers to their ends by doubling, and replaces
    both ends of each edge by what they point to. Edges inside a merged part vanish, so the table shrinks until it is
    empty. At least half of the nodes vanish in a round, so rounds, and doublings in one, grow with the logarithm of the component. Each round is cut off with a
    checkpoint, and checkpoints of rounds before are deleted. Minimum and duplicates are pre-aggregated and pointers are looked up in slots, so neither a node
    with very many links nor a very large component makes a large group.
    """
    live = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    roots = None
    while not live.isEmpty():
        pair = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
        ends = live.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        point = materialize(ends.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")))
        settled = False
        while not settled:  # pointers double their reach until each ends at a local minimum
            further = point.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
            reach = materialize(lookup(point, "root", further, "left"))
            settled = reach.where("next IS NOT NULL").isEmpty()
            if settled:
                release(reach)
            else:
                old, point = point, materialize(reach.select("node", F.coalesce("next", "root").alias("root")))
                release(old, reach)
        step = point.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        if roots is None:
            grown = materialize(point.select("node", "root"))
        else:
            grown = materialize(lookup(roots, "root", step, "left").select("node", F.coalesce("next", "root").alias("root")))
        ra, rb = point.select(F.col("node").alias("a"), F.col("root").alias("ra")), point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        both = lookup(lookup(live, "a", ra), "b", rb).where("ra <> rb")
        left = materialize(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        release(live, point, roots)
        live, roots = left, grown
    return roots if roots is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
