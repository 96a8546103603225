"""Point and neighbour access on frames: vertices (vid, ...) and edges (src, dst[, eid], ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.types import DST, EID, SRC, VID


def find(v: DataFrame, vid: int) -> DataFrame:
    return v.where(F.col(VID) == vid)


def neighbors(e: DataFrame, vid: int, limit: int | None = None) -> DataFrame:
    """Out-neighbours, ascending, with multiplicity."""
    df = e.where(F.col(SRC) == vid).select(DST).orderBy(DST)
    return df if limit is None else df.limit(limit)


def edges_of(e: DataFrame, vid: int, aligned: str = SRC, limit: int | None = None) -> DataFrame:
    df = e.where(F.col(aligned) == vid).orderBy(EID if EID in e.columns else DST)
    return df if limit is None else df.limit(limit)


def batched_neighbors(e: DataFrame, ids: DataFrame) -> DataFrame:
    """(vid, neighbors array) for each distinct id: ascending, with multiplicity, empty where there is none."""
    found = e.join(ids.select(F.col(VID).alias(SRC)).distinct(), SRC, "left_semi").groupBy(SRC).agg(F.sort_array(F.collect_list(DST)).alias("neighbors"))
    asked = ids.select(VID).distinct().join(found.withColumnRenamed(SRC, VID), VID, "left")
    return asked.select(VID, F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def neighbor_pairs(e: DataFrame, ids: DataFrame) -> DataFrame:
    """(vid, neighbor): the same by rows, for ids with very many neighbours."""
    return e.select(F.col(SRC).alias(VID), F.col(DST).alias("neighbor")).join(ids.select(VID).distinct(), VID, "left_semi")


def degrees(v: DataFrame, e: DataFrame, end: str = SRC) -> DataFrame:
    """(vid, degree) for every vertex, 0 where it has no edge."""
    n = e.groupBy(F.col(end).alias(VID)).agg(F.count("*").alias("degree"))
    return v.select(VID).join(n, VID, "left").select(VID, F.coalesce("degree", F.lit(0)).alias("degree"))


def kth_neighbor(e: DataFrame, k: int) -> DataFrame:
    """(vid, neighbor): for each vertex with more than k neighbours, the k-th of them, ascending, from 0."""
    if k < 0:
        raise IndexError("k is negative")
    place = F.row_number().over(W.partitionBy(SRC).orderBy(DST))  # compared as it is, so that tasks keep the first k + 1 a vertex alone
    return e.select(SRC, DST).withColumn("place", place).where(F.col("place") == k + 1).select(F.col(SRC).alias(VID), F.col(DST).alias("neighbor"))


def neighbor_at(e: DataFrame, vid: int, k: int) -> int:
    rows = neighbors(e, vid, k + 1).collect() if k >= 0 else []
    if len(rows) <= k or k < 0:
        raise IndexError(f"vertex {vid} has no neighbour {k}")
    return rows[k][0]


def first_edge(e: DataFrame, vid: int, end: str = SRC, at: int = 0) -> DataFrame:
    """The first edge with that end at place `at` or after."""
    return e.where((F.col(end) == vid) & (F.col(EID) >= at)).orderBy(EID).limit(1)


def first_edges(e: DataFrame, end: str = SRC) -> DataFrame:
    """(vid, eid): for each vertex the place of its first edge; the iteration's next edges follow by eid."""
    return e.groupBy(F.col(end).alias(VID)).agg(F.min(EID).alias(EID))


def next_edges(e: DataFrame, end: str = SRC) -> DataFrame:
    """e with next_eid: the place of the next edge with the same end, null for the last."""
    return e.withColumn("next_eid", F.lead(EID).over(W.partitionBy(end).orderBy(EID)))


def with_primary_keys(e: DataFrame, src_map: DataFrame, dst_map: DataFrame) -> DataFrame:
    """Edges with their ends' primary keys (src_key, dst_key) in front, for exports; maps are (key, vid)."""
    rest = [c for c in e.columns if c not in (SRC, DST)]
    s = src_map.select(F.col("key").alias("src_key"), F.col(VID).alias(SRC))
    d = dst_map.select(F.col("key").alias("dst_key"), F.col(VID).alias(DST))
    return e.join(s, SRC).join(d, DST).select("src_key", "dst_key", *[F.col(f"`{c}`") for c in rest])


def place_of(global_ids: DataFrame, bases: Sequence[tuple[str, int, int]], column: str = "gid") -> DataFrame:
    """(column, type, local): which type a global id belongs to and its id there; bases: (type, base, count), a row a type."""
    case = F.lit(None).cast("string")
    local = F.lit(None).cast("long")
    for name, base, count in bases:
        inside = (F.col(column) >= base) & (F.col(column) < base + count)
        case, local = F.when(inside, F.lit(name)).otherwise(case), F.when(inside, F.col(column) - base).otherwise(local)
    return global_ids.select(column, case.alias("type"), local.alias("local"))
