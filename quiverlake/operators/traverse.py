"""Projections and traversals. A projection is its edges as (src, dst) over ids 0 ... n - 1; loops on the driver hold ids of one level at
most as frames, never as collected rows, and each level is checkpointed."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.types import DST, SRC, VID, Direction
from ..session import Store, checksum, materialize, release
from .index import dense_ids


class CapacityError(ValueError):
    pass


def directed(e: DataFrame, direction: Direction | str = Direction.OUTGOING) -> DataFrame:
    """(src, dst) in a direction; undirected has one entry each way, so a self-loop counts twice and multiplicity stays."""
    direction = Direction(direction)
    out = e.select(SRC, DST)
    back = e.select(F.col(DST).alias(SRC), F.col(SRC).alias(DST))
    return {Direction.OUTGOING: out, Direction.INCOMING: back, Direction.UNDIRECTED: out.unionByName(back)}[direction]


@dataclass(frozen=True)
class Projection:
    """edges: (src, dst), already in the direction; count: of vertices."""

    edges: DataFrame
    count: int
    direction: Direction = Direction.OUTGOING

    def csr(self) -> DataFrame:
        """(vid, neighbors array ascending) for every vertex."""
        near = self.edges.groupBy(F.col(SRC).alias(VID)).agg(F.sort_array(F.collect_list(DST)).alias("neighbors"))
        ids = self.edges.sparkSession.range(self.count).withColumnRenamed("id", VID)
        return ids.join(near, VID, "left").select(VID, F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))

    def merge(self, more: DataFrame) -> Projection:
        """With more edges (src, dst) over the same vertices, taken in the projection's direction."""
        if not more.where((F.col(SRC) < 0) | (F.col(SRC) >= self.count) | (F.col(DST) < 0) | (F.col(DST) >= self.count)).isEmpty():
            raise ValueError("an edge has an end that isn't a vertex")
        return Projection(self.edges.unionByName(directed(more, self.direction)), self.count, self.direction)


def materialize_csr(e: DataFrame, count: int, direction: Direction | str = Direction.OUTGOING, max_vertices: int | None = None, max_edges: int | None = None, same_type: bool = True) -> Projection:
    """A projection of one edge type, checkpointed. Bounds that are exceeded are errors; reversing across two types is refused."""
    direction = Direction(direction)
    if direction is not Direction.OUTGOING and not same_type:
        raise ValueError("edges between two vertex types are projected outgoing, or heterogeneously")
    if max_vertices is not None and count > max_vertices:
        raise CapacityError(f"{count} vertices, more than {max_vertices}")
    edges = materialize(directed(e, direction))
    if max_edges is not None and (n := edges.count()) > max_edges:
        raise CapacityError(f"{n} edges, more than {max_edges}")
    return Projection(edges, count, direction)


class Heterogeneous:
    """Several vertex types in one space of ids: each declared type follows the one before."""

    def __init__(self, direction: Direction | str = Direction.UNDIRECTED):
        self.direction = Direction(direction)
        self.types: list[tuple[str, DataFrame, int]] = []
        self.triplets: list[tuple[tuple[str, str, str], DataFrame]] = []

    def add_vertex_type(self, name: str, ids: DataFrame, count: int | None = None) -> Heterogeneous:
        """ids: (id string, vid) of the type, or (vid)."""
        if any(t[0] == name for t in self.types):
            raise ValueError(f"{name} was declared before")
        ids = ids if "id" in ids.columns else ids.select(F.col(VID).cast("string").alias("id"), VID)
        self.types.append((name, ids.select("id", VID), ids.count() if count is None else count))
        return self

    def add_edge_type(self, src: str, edge: str, dst: str, e: DataFrame) -> Heterogeneous:
        known = {t[0] for t in self.types}
        if src not in known or dst not in known:
            raise KeyError(f"{src if src not in known else dst} wasn't declared")
        self.triplets.append(((src, edge, dst), e.select(SRC, DST)))
        return self

    @property
    def bases(self) -> list[tuple[str, int, int]]:
        """(type, base, count)."""
        out, base = [], 0
        for name, _, n in self.types:
            out.append((name, base, n))
            base += n
        return out

    def base(self, name: str) -> int:
        return next(b for t, b, _ in self.bases if t == name)

    def edges(self) -> DataFrame:
        """The union of all triplets, shifted, before any direction."""
        shift = {t: b for t, b, _ in self.bases}
        frames = [e.select((F.col(SRC) + shift[s]).alias(SRC), (F.col(DST) + shift[d]).alias(DST)) for (s, _, d), e in self.triplets]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def build(self) -> Projection:
        return Projection(directed(self.edges(), self.direction), sum(n for _, _, n in self.types), self.direction)

    def global_index(self) -> DataFrame:
        """(type, id, gid) of every vertex."""
        frames = [ids.select(F.lit(name).alias("type"), "id", (F.col(VID) + self.base(name)).alias("gid")) for name, ids, _ in self.types]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def merge(self, vertices: DataFrame, edges: DataFrame) -> Heterogeneous:
        """With new vertices (type, id) after those of their type, which shifts later types, and edges (src_type, src_id, edge, dst_type, dst_id)."""
        out = Heterogeneous(self.direction)
        for name, ids, n in self.types:
            new = materialize(dense_ids(vertices.where(F.col("type") == name).select("id").distinct().join(ids, "id", "left_anti"), ["id"]))
            grown = ids.unionByName(new.select("id", (F.col(VID) + n).alias(VID)))
            out.types.append((name, materialize(grown), n + new.count()))
        ids_of = {t[0]: t[1] for t in out.types}
        out.triplets = list(self.triplets)
        kinds = [tuple(r) for r in edges.select("src_type", "edge", "dst_type").distinct().collect()]  # a row an edge type
        for s, kind, d in kinds:
            if s not in ids_of or d not in ids_of:
                raise KeyError(f"{s if s not in ids_of else d} wasn't declared")
            own = edges.where((F.col("src_type") == s) & (F.col("edge") == kind) & (F.col("dst_type") == d))
            a = ids_of[s].select(F.col("id").alias("src_id"), F.col(VID).alias(SRC))
            b = ids_of[d].select(F.col("id").alias("dst_id"), F.col(VID).alias(DST))
            for column, known in (("src_id", a), ("dst_id", b)):
                if not own.join(known, column, "left_anti").isEmpty():
                    raise KeyError(f"an edge has an unknown {column}")
            out.triplets.append(((s, kind, d), own.join(a, "src_id").join(b, "dst_id").select(SRC, DST)))
        return out


@dataclass(frozen=True)
class Reached:
    """rows: (vid, depth), each at the depth where it was first seen."""

    rows: DataFrame
    size: int
    truncated: bool

    def ordered(self) -> DataFrame:
        return self.rows.orderBy("depth", VID)

    def frontier_sizes(self) -> DataFrame:
        return self.rows.groupBy("depth").agg(F.count("*").alias("n"))

    def component_id(self) -> int | None:
        """The smallest vertex, for a whole component."""
        return None if self.truncated else self.rows.agg(F.min(VID)).first()[0]


def neighborhood(p: Projection, start: int, max_depth: int, max_nodes: int, keep_every: int = 4) -> Reached:
    """Breadth first from start: at most max_depth levels and max_nodes vertices, start included.

    In a level that the budget cuts, those are kept that are discovered first: by the smallest vertex of the level before that leads to them, then by id.
    """
    if max_depth < 0:
        raise ValueError("the depth is negative")
    if max_nodes < 1:
        raise ValueError("the budget isn't positive")
    if not 0 <= start < p.count:
        raise ValueError(f"vertex {start} isn't in the graph")
    spark = p.edges.sparkSession
    budget = min(max_nodes, p.count)
    seen = spark.createDataFrame([(start, 0)], f"{VID} long, depth int")
    frontier, size, truncated, depth, stored = seen.select(VID), 1, False, 0, []
    while depth < max_depth and not truncated:
        depth += 1
        step = p.edges.join(frontier.withColumnRenamed(VID, SRC), SRC).groupBy(F.col(DST).alias(VID)).agg(F.min(SRC).alias("via"))
        new = materialize(step.join(seen.select(VID), VID, "left_anti"))
        n = new.count()
        if not n:
            break
        if n > budget - size:
            truncated = True
            if size == budget:
                break
            whole, new = new, materialize(new.orderBy("via", VID).limit(budget - size))
            release(whole)
            n = budget - size
        frontier = new.select(VID)
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        size += n
        if depth % keep_every == 0:
            seen = materialize(seen)
            release(*stored)
            stored = [seen]
        stored.append(new)
    return Reached(seen, size, truncated)


def component(p: Projection, start: int, max_nodes: int) -> Reached:
    """The whole component of start; a component only if it isn't truncated."""
    return neighborhood(p, start, 2**31 - 1, max_nodes)


def walk_frontiers(p: Projection, start: int, hops: int) -> list[DataFrame]:
    """Vertices that walks of 0, 1, ... hops reach: repeated inside no hop, but revisited by later ones."""
    out = [p.edges.sparkSession.createDataFrame([(start,)], f"{VID} long")]
    for _ in range(hops):
        out.append(materialize(p.edges.join(out[-1].withColumnRenamed(VID, SRC), SRC).select(F.col(DST).alias(VID)).distinct()))
    return out


def hops_between(p: Projection, pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, hops) for each distinct pair: the least number of hops, or -1 if it is more than `most`. The projection is undirected."""
    asked = materialize(pairs.select("a", "b").distinct())
    live = asked.select("a", F.col("a").alias("at")).distinct()
    reached = materialize(live.withColumn("hops", F.lit(0)))
    front = reached
    for hop in range(1, most + 1):
        step = front.select("a", F.col("at").alias(SRC)).join(p.edges, SRC).select("a", F.col(DST).alias("at")).distinct()
        front = materialize(step.join(reached.select("a", "at"), ["a", "at"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        reached = materialize(reached.unionByName(front))
    found = asked.join(reached.withColumnRenamed("at", "b"), ["a", "b"], "left")
    return found.select("a", "b", F.coalesce("hops", F.lit(-1)).alias("hops"))


class ServedProjection:
    """A projection that readers share while one writer at a time replaces it; each replacement has a new generation."""

    def __init__(self, build: Callable[[], Projection]):
        self._build, self._swap, self._refresh = build, threading.Lock(), threading.Lock()
        self._current, self._generation, self._at = build(), 1, time.monotonic()

    def current(self) -> tuple[Projection, int]:
        with self._swap:
            return self._current, self._generation

    def publish(self, p: Projection) -> int:
        with self._swap:
            self._current, self._generation, self._at = p, self._generation + 1, time.monotonic()
            return self._generation

    def refresh(self) -> int:
        """Rebuild; a caller that finds a rebuild under way waits for it and builds nothing."""
        _, before = self.current()
        with self._refresh:
            _, now = self.current()
            return now if now != before else self.publish(self._build())

    def refresh_if_stale(self, max_age: float) -> bool:
        with self._swap:
            fresh = time.monotonic() - self._at <= max_age
        if fresh:
            return False
        self.refresh()
        return True

    def merge(self, more: DataFrame) -> int:
        with self._refresh:
            return self.publish(self.current()[0].merge(more))

    def rewrite_dataset(self, write: Callable[[], None]) -> int:
        """Run a rewrite of what the projection is built from, then rebuild."""
        with self._refresh:
            write()
            return self.publish(self._build())


def write_snapshot(p: Projection, path: str) -> None:
    """The projection as Parquet, committed by a small header with its number of vertices and the checksum of its edges.

    An older snapshot's header goes first, so a crash leaves a folder without a header, which isn't a snapshot.
    """
    spark, path = p.edges.sparkSession, path.rstrip("/")
    store = Store(spark)
    store.delete(f"{path}/header.json")
    p.edges.select(SRC, DST).write.mode("overwrite").parquet(f"{path}/edges")
    head = {"vertices": p.count, "direction": p.direction.value, "edges": checksum(spark.read.parquet(f"{path}/edges").select(SRC, DST))}
    store.write_text(f"{path}/.header.tmp", json.dumps(head))
    store.rename(f"{path}/.header.tmp", f"{path}/header.json")


def read_snapshot(spark: SparkSession, path: str) -> Projection:
    """The snapshot; one without a header, or whose edges don't agree with their checksum, is refused."""
    path = path.rstrip("/")
    if not Store(spark).exists(f"{path}/header.json"):
        raise ValueError("the snapshot has no header: it was never finished")
    head = json.loads(Store(spark).read_text(f"{path}/header.json"))
    edges = spark.read.parquet(f"{path}/edges").select(SRC, DST)
    if checksum(edges) != head["edges"]:
        raise ValueError("the snapshot is corrupt: its edges don't agree with its header")
    return Projection(edges, head["vertices"], Direction(head["direction"]))


def levels(p: Projection, roots: Sequence[int], most: int | None = None) -> DataFrame:
    """(vid, distance) from the nearest root for every vertex, -1 where none reaches it, or none within `most` hops if that is given."""
    spark = p.edges.sparkSession
    seen = spark.createDataFrame([(r, 0) for r in roots], f"{VID} long, distance int")
    frontier, hop, stored = seen.select(VID), 0, []
    while most is None or hop < most:
        hop += 1
        step = p.edges.join(frontier.withColumnRenamed(VID, SRC), SRC).select(F.col(DST).alias(VID)).distinct()
        frontier = materialize(step.join(seen.select(VID), VID, "left_anti"))
        if frontier.isEmpty():
            release(frontier)
            break
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(hop)))
        if hop % 4 == 0:
            seen = materialize(seen)
            release(*stored)
            stored = [seen]
        stored.append(frontier)
    ids = spark.range(p.count).withColumnRenamed("id", VID)
    return ids.join(seen, VID, "left").select(VID, F.coalesce("distance", F.lit(-1)).alias("distance"))
