"""Folding patches into one vertex chunk of a stored ordered layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.info import EdgeInfo
from ..plans.types import DST, SRC, AdjListType
from ..session import materialize
from ..sinks.writers import rewrite_edge_partition
from ..sources.readers import EdgeReader

SUMMARY = "vertex_chunk long, base_edges long, patch_edges long, total_edges long, edge_chunks long, watermark long"


def compact_chunk(prefix: str, info: EdgeInfo, layout: AdjListType | str, part: int, patches: DataFrame, watermark: int) -> DataFrame:
    """Rewrite one vertex chunk with its base edges and those patches (seq, src, dst, properties) that fall in it and come before the watermark.

    One row says what was done. Without such patches nothing is rewritten. Dropping the absorbed patches afterwards is the caller's, so a crash
    between the two folds them again at worst; later arrivals aren't touched. Patches that lack a property have it null.
    """
    layout = AdjListType(layout)
    if not layout.ordered:
        raise ValueError("only ordered layouts are compacted")
    spark = patches.sparkSession
    reader = EdgeReader(prefix, info, layout, spark)
    aligned = SRC if layout.by_source else DST
    mine = patches.where((F.col("seq") < watermark) & (F.floor(F.col(aligned) / info.aligned_chunk(layout)) == part))
    base_n, patch_n = reader.read_edges_number(part), mine.count()
    total = base_n + patch_n
    if patch_n:
        names = [p.name for p in info.properties]
        base = reader.read_edges_for_vertex_chunk(part, False).select(SRC, DST, *names)
        types = {p.name: p.spark_type() for p in info.properties}
        more = mine.select(SRC, DST, *[F.col(f"`{n}`") if n in mine.columns else F.lit(None).cast(types[n]).alias(n) for n in names])
        rewrite_edge_partition(prefix, info, layout, part, materialize(base.unionByName(more)), reader.read_vertices_number())
    return spark.createDataFrame([(part, base_n, patch_n, total, -(-total // info.chunk_size), watermark)], SUMMARY)


def remaining(patches: DataFrame, info: EdgeInfo, layout: AdjListType | str, part: int, watermark: int) -> DataFrame:
    """The patches that a compaction of one vertex chunk left: other chunks' and later ones."""
    aligned = SRC if AdjListType(layout).by_source else DST
    gone = (F.col("seq") < watermark) & (F.floor(F.col(aligned) / info.aligned_chunk(layout)) == part)
    return patches.where(~gone)
