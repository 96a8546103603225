"""Updates: arrivals against a stored order, an append-only delta over an immutable base, views pinned to a sequence number.

A delta is a folder of committed Parquet batches. A batch is written under a hidden name and renamed to `batch-<first>-<end>`, which
commits it; what a crash leaves behind has no such name and is ignored. Each batch holds a record of its checksum, which recovery compares:
a torn last batch is set aside, a damaged earlier one is an error. One writer appends at a time; readers pin a sequence number.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.info import EdgeInfo
from ..plans.types import DST, SRC, VID, AdjListType, Direction
from ..session import Store, checksum
from .index import IndexGenerator, dense_ids
from .traverse import CapacityError, Projection, Reached, directed, neighborhood

APPEND_TAIL, PATCH = "APPEND_TAIL", "PATCH"
#: A batch's record, which Spark's readers skip, and its columns.
RECORD, BATCH = "_checksum.json", f"seq long, {SRC} long, {DST} long"


def ordering_of(info: EdgeInfo, layout: AdjListType | str) -> tuple[str, str]:
    """(primary, secondary) column of an ordered layout."""
    layout = AdjListType(layout)
    info.adj_list(layout)
    if not layout.ordered:
        raise ValueError("unordered layouts have no order")
    return (SRC, DST) if layout.by_source else (DST, SRC)


def arrival_class(primary: Column, secondary: Column, frontier: tuple[int, int] | None) -> Column:
    """APPEND_TAIL for keys at or after the frontier, the last key that is stored; PATCH otherwise. An empty base takes all at its tail."""
    if frontier is None:
        return F.lit(APPEND_TAIL)
    fp, fs = frontier
    return F.when((primary > fp) | ((primary == fp) & (secondary >= fs)), APPEND_TAIL).otherwise(PATCH)


def classify(arrivals: DataFrame, info: EdgeInfo, layout: AdjListType | str, frontier: tuple[int, int] | None) -> DataFrame:
    """arrivals with arrival_class and the vertex chunk they fall in."""
    p, s = ordering_of(info, layout)
    chunk = F.floor(F.col(p) / info.aligned_chunk(layout)).cast("long")
    return arrivals.withColumn("arrival_class", arrival_class(F.col(p), F.col(s), frontier)).withColumn("vertex_chunk", chunk)


def frontier_of(e: DataFrame, info: EdgeInfo, layout: AdjListType | str) -> tuple[int, int] | None:
    p, s = ordering_of(info, layout)
    row = e.agg(F.max(F.struct(p, s)).alias("m")).first().m
    return None if row is None else (row[0], row[1])


def patched_chunks(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("arrival_class") == PATCH).select("vertex_chunk").distinct().orderBy("vertex_chunk")


@dataclass(frozen=True)
class GraphView:
    """A base with the delta's edges from `floor` up to `end`, not including it."""

    base: Projection
    delta: DataFrame
    count: int

    @property
    def projection(self) -> Projection:
        return Projection(self.base.edges.unionByName(directed(self.delta, self.base.direction)), self.count, self.base.direction)

    def degree(self, vid: int) -> DataFrame:
        return self.projection.edges.where(F.col(SRC) == vid).agg(F.count("*").alias("degree"))

    def neighbors(self, vid: int) -> DataFrame:
        """Ascending; edges of base and delta keep their multiplicity."""
        return self.projection.edges.where(F.col(SRC) == vid).select(DST).orderBy(DST)

    def neighborhood(self, start: int, max_depth: int, max_nodes: int) -> Reached:
        return neighborhood(self.projection, start, max_depth, max_nodes)

    def component(self, start: int, max_nodes: int) -> Reached:
        return neighborhood(self.projection, start, 2**31 - 1, max_nodes)


class MutableDelta:
    """A delta in a folder, pinned to the number of vertices and the direction of its base."""

    def __init__(self, spark: SparkSession, path: str, base: Projection, capacity: int = 8_000_000, vertices: int | None = None):
        self.spark, self.path, self.base, self.capacity = spark, path.rstrip("/"), base, capacity
        self.store = Store(spark)
        head, spare = f"{self.path}/header.json", f"{self.path}/.header.tmp"
        if not self.store.exists(head) and self.store.exists(spare) and self._complete(spare):
            self.store.rename(spare, head)  # a crash came after the older header was moved aside
        if self.store.exists(head):
            h = json.loads(self.store.read_text(head))
            if (h["base_vertices"], h["direction"]) != (base.count, base.direction.value):
                raise ValueError("the delta belongs to another base")
            self.floor, self._vertices = h["floor"], h["vertices"]
        else:
            self.floor, self._vertices = 0, base.count if vertices is None else vertices
            self._save()
        self.next = max([self.floor, *[end for _, end, _ in self.batches()]])
        self.sealed = self.next  # what a crash left committed is visible again

    def _complete(self, path: str) -> bool:
        try:
            return "floor" in json.loads(self.store.read_text(path))
        except ValueError:
            return False

    def _save(self) -> None:
        head = {"base_vertices": self.base.count, "direction": self.base.direction.value, "floor": self.floor, "vertices": self._vertices}
        self.store.make(self.path)
        self.store.write_text(f"{self.path}/.header.tmp", json.dumps(head))
        self.store.rename(f"{self.path}/.header.tmp", f"{self.path}/header.json")

    @classmethod
    def recover(cls, spark: SparkSession, path: str, base: Projection, **options) -> MutableDelta:
        """Reopen after a crash: unfinished batches are deleted; a last batch that doesn't agree with its checksum is set aside, as `.torn-<first>-<end>-...`.

        Damage in an earlier batch, or a missing one, can't be mended and is an error.
        """
        out = cls(spark, path, base, **options)
        for p, is_dir, _ in out.store.list(path):
            if is_dir and p.rsplit("/", 1)[1].startswith(".staging-"):
                out.store.delete(p)
        batches = [b for b in out.batches() if b[1] > out.floor]
        if any(b[0] != a[1] for a, b in zip(batches, batches[1:], strict=False)) or (batches and batches[0][0] > out.floor):
            raise ValueError("a batch of the delta is missing")
        for first, end, p in batches:
            if out._sound(first, end, p):
                continue
            if end != out.next:
                raise ValueError(f"the batch {first}-{end} of the delta is damaged")
            out.store.rename(p, f"{out.path}/.torn-{first}-{end}-{uuid4().hex}")
            out.next = out.sealed = max(first, out.floor)
        return out

    def _sound(self, first: int, end: int, path: str) -> bool:
        record = f"{path}/{RECORD}"
        if not self.store.exists(record):
            return False
        try:
            want = json.loads(self.store.read_text(record))
            return want["rows"] == end - first and checksum(self.spark.read.schema(BATCH).parquet(path)) == want
        except (ValueError, KeyError, TypeError, PySparkException, Py4JJavaError):
            return False  # an unreadable file is damage like any other

    def batches(self) -> list[tuple[int, int, str]]:
        found = [(m, p) for p, is_dir, _ in self.store.list(self.path) if is_dir and (m := re.fullmatch(r"batch-(\d+)-(\d+)", p.rsplit("/", 1)[1]))]
        return sorted((int(m[1]), int(m[2]), p) for m, p in found)

    @property
    def vertices(self) -> int:
        return self._vertices

    def add_vertices(self, n: int) -> range:
        """Ids for n new vertices, after all known ones."""
        new = range(self._vertices, self._vertices + n)
        self._vertices += n
        self._save()
        return new

    def vertex_ids(self, known: DataFrame, arriving: DataFrame) -> DataFrame:
        """known (id, vid) with new external ids of arriving (id) numbered after all known vertices."""
        grown = IndexGenerator.extend(known, arriving)
        self._vertices = max(self._vertices, grown.agg(F.max(VID)).first()[0] + 1)
        self._save()
        return grown

    def append_all(self, edges: DataFrame) -> tuple[int, int]:
        """Number and commit edges (src, dst), in the order of src, dst; the sequence numbers [first, end). They can't be seen before seal()."""
        outside = (F.col(SRC) < 0) | (F.col(SRC) >= self._vertices) | (F.col(DST) < 0) | (F.col(DST) >= self._vertices)
        numbered = dense_ids(edges.select(SRC, DST), [SRC, DST], "seq").withColumn("seq", F.col("seq") + self.next)
        row = numbered.agg(F.count("*").alias("n"), F.count_if(outside | F.col(SRC).isNull() | F.col(DST).isNull()).alias("bad")).first()
        if row.bad:
            raise ValueError(f"{row.bad} edges have an end that isn't a vertex")
        if self.next - self.floor + row.n > self.capacity:
            raise CapacityError(f"more than {self.capacity} edges in the delta")
        first, end = self.next, self.next + row.n
        if row.n:
            staging = f"{self.path}/.staging-{uuid4().hex}"
            numbered.select("seq", SRC, DST).write.parquet(staging)
            self.store.write_text(f"{staging}/{RECORD}", json.dumps(checksum(self.spark.read.schema(BATCH).parquet(staging))))
            self.store.rename(staging, f"{self.path}/batch-{first}-{end}")
            self.next = end
        return first, end

    def append(self, src: int, dst: int) -> int:
        return self.append_all(self.spark.createDataFrame([(src, dst)], f"{SRC} long, {DST} long"))[0]

    def seal(self) -> int:
        """Make what was appended visible; the sequence number to pin."""
        self.sealed = self.next
        return self.sealed

    def edges(self, end: int | None = None) -> DataFrame:
        """(seq, src, dst) of the sealed edges before `end`."""
        end = self.sealed if end is None else end
        if not self.floor <= end <= self.sealed:
            raise ValueError(f"sealed numbers run from {self.floor} to {self.sealed}")
        files = [p for a, b, p in self.batches() if a < end and b > self.floor]
        if not files:
            return self.spark.createDataFrame([], f"seq long, {SRC} long, {DST} long")
        return self.spark.read.parquet(*files).select("seq", SRC, DST).where((F.col("seq") >= self.floor) & (F.col("seq") < end))

    def view(self, end: int | None = None) -> GraphView:
        return GraphView(self.base, self.edges(end).select(SRC, DST), self._vertices)

    def rebase(self, base: Projection, absorbed: int) -> None:
        """Onto a base that holds the edges before `absorbed`; later ones survive, and no vertex changes its number."""
        if not self.floor <= absorbed <= self.next or base.direction is not self.base.direction or base.count > self._vertices:
            raise ValueError("the base doesn't follow the present one")
        self.base, self.floor = base, absorbed
        self._save()
        for a, b, p in self.batches():
            if b <= absorbed:
                self.store.delete(p)
        self.sealed = max(self.sealed, absorbed)


def delta_by_chunk(delta: DataFrame, chunk_size: int, bytes_per_entry: int = 16) -> DataFrame:
    """(chunk, patched_vertices, entries, bytes) of edges (src, dst) by the source's chunk."""
    chunk = F.floor(F.col(SRC) / chunk_size).cast("long").alias("chunk")
    return delta.groupBy(chunk).agg(F.count_distinct(SRC).alias("patched_vertices"), F.count("*").alias("entries"), (F.count("*") * bytes_per_entry).alias("bytes"))


def read_penalty(profile: DataFrame, base_degrees: DataFrame, delta: DataFrame, bytes_per_entry: int = 16) -> DataFrame:
    """One row: what reads cost more because of the delta.

    profile: (vid, weight), how often vertices are read; base_degrees: (vid, degree). probability_of_patched_read, expected_extra_entries,
    expected_extra_bytes and expected_base_entries a read, and read_amplification = (base + extra) / base: 1 if both are 0, infinite if only the base is.
    """
    extra = delta.groupBy(F.col(SRC).alias(VID)).agg(F.count("*").alias("extra"))
    t = profile.join(base_degrees, VID, "left").join(extra, VID, "left")
    w, x, d = F.col("weight"), F.coalesce("extra", F.lit(0)), F.coalesce("degree", F.lit(0))
    total = F.sum(w)
    one = t.agg((F.sum(F.when(x > 0, w).otherwise(0.0)) / total).alias("probability_of_patched_read"), (F.sum(w * x) / total).alias("expected_extra_entries"), (F.sum(w * d) / total).alias("expected_base_entries"))
    base, more = F.col("expected_base_entries"), F.col("expected_extra_entries")
    amplification = F.when(base > 0, (base + more) / base).when(more > 0, F.lit(math.inf)).otherwise(F.lit(1.0))
    return one.withColumn("expected_extra_bytes", more * bytes_per_entry).withColumn("read_amplification", amplification)


def mutable_base(e: DataFrame, count: int, direction: Direction | str = Direction.OUTGOING) -> Projection:
    return Projection(directed(e, direction), count, Direction(direction))
