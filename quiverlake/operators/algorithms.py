"""Graph programs: PageRank, weakly connected components, BFS distances and parents, results written back as properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.info import Property, PropertyGroup, VertexInfo
from ..plans.types import DST, SRC, VID
from ..session import materialize, release
from .traverse import Projection, levels


def pagerank(e: DataFrame, count: int, damping: float = 0.85, rounds: int = 10, keep_every: int = 2) -> DataFrame:
    """(vid, rank): all start at 1/n; a vertex without out-edges keeps damping times its own rank instead of sharing it out.

    Multi-edges count as often as they are there. Out-degrees are joined to the edges once; a round is one join on the source and one
    pre-aggregated sum by destination.
    """
    spark = e.sparkSession
    ids = spark.range(count).withColumnRenamed("id", VID)
    degree = e.groupBy(F.col(SRC).alias(VID)).agg(F.count("*").alias("degree"))
    ids = materialize(ids.join(degree, VID, "left"))
    links = materialize(e.groupBy(SRC, DST).agg(F.count("*").alias("times")))
    ranks, stored = ids.withColumn("rank", F.lit(1.0 / count if count else 0.0)), None
    for i in range(1, rounds + 1):
        given = ranks.where("degree IS NOT NULL").select(F.col(VID).alias(SRC), (F.col("rank") / F.col("degree")).alias("share"))
        got = links.join(given, SRC).groupBy(F.col(DST).alias(VID)).agg(F.sum(F.col("share") * F.col("times")).alias("got"))
        own = F.when(F.col("degree").isNull(), F.col("rank") * damping).otherwise(0.0)
        ranks = ranks.join(got, VID, "left").select(VID, "degree", (F.coalesce("got", F.lit(0.0)) * damping + (1 - damping) / count + own).alias("rank"))
        if i % keep_every == 0:
            ranks = materialize(ranks)
            release(stored)
            stored = ranks
    return ranks.select(VID, "rank")


def connected_components(e: DataFrame, count: int) -> DataFrame:
    """(vid, component) for every vertex: the smallest vertex that undirected edges reach.

    Edges are contracted: each vertex points to its smallest neighbour, pointers are followed to their ends by doubling, and edges are rewritten to what they point to,
    so the number of rounds grows with the logarithm of the longest path.
    """
    spark = e.sparkSession
    live = materialize(e.where(F.col(SRC) != F.col(DST)).select(F.least(SRC, DST).alias("a"), F.greatest(SRC, DST).alias("b")).distinct())
    names = spark.range(count).select(F.col("id").alias(VID), F.col("id").alias("component"))
    while not live.isEmpty():
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored = materialize(ends.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        settled = False
        while not settled:  # pointers double their reach until each ends at a local minimum
            further = point.select(F.col("a").alias("to"), F.col("to").alias("next"))
            reach = materialize(point.join(further, "to").select("a", "to", "next"))
            release(stored)
            settled = reach.where("next <> to").isEmpty()
            point, stored = reach.select("a", F.col("next").alias("to")), reach
        older, names = names, names.join(point.withColumnRenamed("a", "component"), "component", "left").select(VID, F.coalesce("to", "component").alias("component"))
        names = materialize(names)
        release(older)
        ra, rb = point.select("a", F.col("to").alias("ra")), point.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        older, live = live, live.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        live = materialize(live)
        release(older, stored)
    least = names.groupBy("component").agg(F.min(VID).alias("least"))
    return names.join(least, "component").select(VID, F.col("least").alias("component"))


def component_count(components: DataFrame) -> DataFrame:
    return components.agg(F.count_distinct("component").alias("n"))


def bfs(p: Projection, root: int, most: int | None = None) -> DataFrame:
    """(vid, distance) from root along the projection's edges, -1 where unreached; most: hops after which the search ends, unbounded unless given."""
    return levels(p, [root], most)


def bfs_parents(p: Projection, root: int, most: int | None = None) -> DataFrame:
    """(vid, parent): the root is its own; -1 where unreached (within `most` hops, if given); of several, the smallest vertex of the level before."""
    found = materialize(levels(p, [root], most))
    near = found.where("distance >= 0")
    s = near.select(F.col(VID).alias(SRC), F.col("distance").alias("ds"))
    d = near.select(F.col(VID).alias(DST), F.col("distance").alias("dd"))
    up = p.edges.join(s, SRC).join(d, DST).where("dd = ds + 1").groupBy(F.col(DST).alias(VID)).agg(F.min(SRC).alias("parent"))
    out = found.join(up, VID, "left")
    return out.select(VID, F.when(F.col("distance") == 0, F.col(VID)).when(F.col("distance") > 0, F.col("parent")).otherwise(F.lit(-1)).alias("parent"))


def write_back(prefix: str, info: VertexInfo, result: DataFrame, name: str, type_: str, file_type: str = "parquet") -> VertexInfo:
    """A column of result (vid, name) as a new property group of a stored vertex type; the new metadata is returned."""
    from ..sinks.writers import VertexWriter

    group = PropertyGroup((Property(name, type_),), file_type)
    grown = info.with_group(group)
    VertexWriter(prefix, grown, result.select(VID, name)).write_vertex_properties(group)
    return grown
