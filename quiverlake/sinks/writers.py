"""Writers of vertices, edges and whole graphs.

Publication order: data, then counts, then metadata, so that an archive whose metadata is there is complete.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from enum import Enum
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.index import IndexGenerator, dense_ids
from ..plans import paths
from ..plans.info import EDGE_CHUNK, VERTEX_CHUNK, EdgeInfo, GraphInfo, PropertyGroup, VertexInfo, infer_graph_info
from ..plans.types import DST, LABELS, SRC, VID, AdjListType, Cardinality, FileType, Reserved
from ..session import POOL, Store, side_by_side
from ..sources.control import write_value
from .chunks import write_chunks


class WriteMode(str, Enum):
    """append is known so that it can be refused: a chunk is written once and as a whole; deltas take what arrives later."""

    CREATE_NEW = "create_new"
    OVERWRITE = "overwrite"
    APPEND = "append"

    @classmethod
    def replaces(cls, mode: WriteMode | str) -> bool:
        if cls(mode) is cls.APPEND:
            raise ValueError("chunks can't be appended to; write a delta, or rewrite the chunk")
        return cls(mode) is cls.OVERWRITE


class ValidateLevel(str, Enum):
    """no: nothing; weak: what the plan tells (columns, types); strong: what the rows tell too."""

    NO = "no"
    WEAK = "weak"
    STRONG = "strong"


def check_columns(df: DataFrame, groups: Sequence[PropertyGroup]) -> None:
    types = dict(df.dtypes)
    for g in groups:
        for p in g.properties:
            if p.name not in types:
                raise ValueError(f"the frame lacks property {p.name}")
            have, want = df.schema[p.name].dataType, p.spark_type()
            if have.simpleString() != want.simpleString() and not (want.simpleString() == "timestamp" and have.simpleString() == "timestamp_ntz"):
                raise TypeError(f"{p.name} is {have.simpleString()}, the metadata says {want.simpleString()}")


def check_rows(df: DataFrame, groups: Sequence[PropertyGroup], dense: str | None = None) -> None:
    """One pass over the rows: nulls where none may be, repeated members of sets, ids that aren't dense."""
    tests = {}
    for g in groups:
        for p in g.properties:
            if not p.is_nullable:
                tests[f"nulls in {p.name}"] = F.count_if(F.col(f"`{p.name}`").isNull())
            if p.cardinality is Cardinality.SET:
                tests[f"repeated members in the set {p.name}"] = F.count_if(F.size(f"`{p.name}`") != F.size(F.array_distinct(F.col(f"`{p.name}`"))))
    if dense is not None:
        tests["ids that aren't 0, 1, 2, ..."] = F.count_if(F.col(dense).isNull() | (F.col(dense) < 0)) + F.abs(F.coalesce(F.max(dense), F.lit(-1)) + 1 - F.count("*"))
    if tests:
        row = df.agg(*[t.alias(k) for k, t in tests.items()]).first().asDict()
        if bad := [f"{n} {k}" for k, n in row.items() if n]:
            raise ValueError("; ".join(bad))


class VertexWriter:
    """Writes one vertex type from a frame with the column vid."""

    def __init__(self, prefix: str, info: VertexInfo, df: DataFrame, count: int | None = None, level: ValidateLevel = ValidateLevel.WEAK, mode: WriteMode = WriteMode.OVERWRITE, reserved: Reserved | None = None):
        if VID not in df.columns:
            raise ValueError(f"the frame lacks {VID}")
        if bad := info.issues():
            raise ValueError("; ".join(bad))
        self.prefix, self.info, self.df, self.reserved = prefix, info, df, reserved or Reserved()
        self.level, self.replace = ValidateLevel(level), WriteMode.replaces(mode)
        self.count = df.count() if count is None else count

    def _check(self, groups: Sequence[PropertyGroup]) -> None:
        if self.level is not ValidateLevel.NO:
            check_columns(self.df, groups)
        if self.level is ValidateLevel.STRONG:
            check_rows(self.df, groups, VID)

    def write_vertices_number(self) -> None:
        write_value(self.df.sparkSession, paths.vertex_count(self.prefix, self.info), self.count)

    def _chunked(self) -> DataFrame:
        return self.df.withColumn("__chunk", F.floor(F.col(VID) / self.info.chunk_size).cast("long"))

    def write_vertex_properties(self, group: PropertyGroup | None = None) -> None:
        """One group, or all."""
        groups = list(self.info.property_groups) if group is None else [group]
        if group is not None and group not in self.info.property_groups:
            raise KeyError("no such property group")
        self._check(groups)
        side_by_side(*[partial(self._write_group, g) for g in groups])

    def _write_group(self, g: PropertyGroup) -> None:
        df = self._chunked().withColumnRenamed(VID, self.reserved.vertex)
        name_of = partial(paths.vertex_chunk, self.prefix, self.info, g)
        columns, base = [self.reserved.vertex, *g.names], paths.vertex_group(self.prefix, self.info, g)
        write_chunks(df, ["__chunk"], [self.reserved.vertex], columns, g.file_type, base, name_of, self.replace, self._chunks, self.info.chunk_size)

    @property
    def _chunks(self) -> int:
        return paths.chunk_count(self.count, self.info.chunk_size)

    def write_vertex_labels(self) -> None:
        """A boolean column for each label of the type, from the column :LABEL."""
        if not self.info.labels:
            raise ValueError(f"{self.info.type} has no labels")
        if LABELS not in self.df.columns:
            raise ValueError(f"the frame lacks {LABELS}")
        held = F.coalesce(F.col(f"`{LABELS}`"), F.array().cast("array<string>"))
        df = self._chunked().select("__chunk", VID, *[F.array_contains(held, F.lit(x)).alias(x) for x in self.info.labels])
        name_of = partial(paths.label_chunk, self.prefix, self.info)
        base = paths.label_folder(self.prefix, self.info)
        write_chunks(df, ["__chunk"], [VID], list(self.info.labels), FileType.PARQUET, base, name_of, self.replace, self._chunks, self.info.chunk_size)

    def write(self) -> None:
        """Groups and labels, then the count."""
        self._check(self.info.property_groups)
        jobs = [partial(self._write_group, g) for g in self.info.property_groups]
        side_by_side(*jobs, *([self.write_vertex_labels] if self.info.labels else []))
        self.write_vertices_number()

    def write_vertex_partition(self, chunk: int) -> None:
        """Rewrite exactly one chunk of each group."""
        rows = self.df.where(F.floor(F.col(VID) / self.info.chunk_size) == chunk)
        VertexWriter(self.prefix, self.info, rows, self.count, ValidateLevel.NO, WriteMode.OVERWRITE, self.reserved).write_vertex_properties()


class EdgeWriter:
    """Writes one layout of an edge type from a frame with the columns src and dst.

    count: of the aligned vertex type. Rows are numbered in the order of part, ends and properties by ranges of these, so the
    edges of one vertex, however many, are dealt to several tasks. The ordered rows are checkpointed once; adjacency, offsets and every property
    group number them by two small broadcast tables, so all see the same order and none shuffles by vertex chunk."""

    MAX_BROADCAST_PARTS = 1_000_000  # rows of two longs

    def __init__(self, prefix: str, info: EdgeInfo, layout: AdjListType | str, count: int, df: DataFrame, level: ValidateLevel = ValidateLevel.WEAK, mode: WriteMode = WriteMode.OVERWRITE, reserved: Reserved | None = None):
        if SRC not in df.columns or DST not in df.columns:
            raise ValueError(f"the frame lacks {SRC} or {DST}")
        if bad := info.issues():
            raise ValueError("; ".join(bad))
        self.prefix, self.info, self.layout, self.count = prefix, info, AdjListType(layout), count
        self.adj = info.adj_list(self.layout)
        self.level, self.replace, self.reserved = ValidateLevel(level), WriteMode.replaces(mode), reserved or Reserved()
        self.aligned, self.other = (SRC, DST) if self.layout.by_source else (DST, SRC)
        self.size = info.aligned_chunk(self.layout)
        self.spark = df.sparkSession
        if self.level is not ValidateLevel.NO:
            check_columns(df, info.property_groups)
        if self.level is ValidateLevel.STRONG:
            check_rows(df, info.property_groups)
            if (bad := df.where(F.col(self.aligned).isNull() | F.col(self.other).isNull() | (F.col(self.aligned) < 0) | (F.col(self.aligned) >= count) | (F.col(self.other) < 0)).count()) > 0:
                raise ValueError(f"{bad} edges have an end out of bounds")
        keep = [SRC, DST, *[p.name for p in info.properties]]
        parted = df.select(*[F.col(f"`{c}`") for c in keep], F.floor(F.col(self.aligned) / self.size).cast("long").alias("__part"))
        # repeated edges keep their multiplicity; their properties order them
        numbered = dense_ids(parted, ["__part", self.aligned, self.other, *[p.name for p in info.properties]], "__place")
        per = {r["__part"]: r.n for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect()}
        self.counts = [per.get(p, 0) for p in range(paths.chunk_count(count, self.size))]  # a number a vertex chunk
        before, starts = 0, []
        for part in sorted(p for p in per if p is not None):
            starts.append((part, before))
            before += per[part]
        self.chunks = sum(paths.chunk_count(n, info.chunk_size) for n in self.counts)
        table = self.spark.createDataFrame(starts, "__part long, __start long")  # a row a vertex chunk
        placed = numbered.join(F.broadcast(table) if len(starts) <= self.MAX_BROADCAST_PARTS else table, "__part").withColumn("__place", F.col("__place") - F.col("__start")).drop("__start")
        self.rows = placed.withColumn("__chunk", F.floor(F.col("__place") / info.chunk_size).cast("long"))

    def write_edge_counts(self) -> None:
        """The aligned type's count and a count for every vertex chunk, empty ones too."""
        store = Store(self.spark)
        list(POOL.map(lambda p: self.write_edge_count(*p, store), enumerate(self.counts)))
        write_value(self.spark, paths.edge_vertex_count(self.prefix, self.info, self.layout), self.count)

    def write_edge_count(self, part: int, n: int, store: Store | None = None) -> None:
        write_value(self.spark, paths.edge_count(self.prefix, self.info, self.layout, part), n, store)

    def offsets(self, part: int | None = None) -> DataFrame:
        """(part, vid, offset): for each aligned vertex where its edges begin in its part; then where the part ends. A part's
        vertices meet in one task, which the metadata bounds."""
        degree = self.rows.groupBy(F.col(self.aligned).alias(VID)).agg(F.count("*").alias("n"))
        first, end = (0, self.count) if part is None else (part * self.size, min(self.count, (part + 1) * self.size))
        ids = self.spark.range(first, end).select(F.col("id").alias(VID), F.floor(F.col("id") / self.size).cast("long").alias("part"))
        ids = ids.join(degree, VID, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        up = F.sum("n").over(W.partitionBy("part").orderBy(VID).rowsBetween(W.unboundedPreceding, 0))
        place = lambda vid, at: F.struct(vid.alias(VID), at.cast("long").alias("offset"))
        after = place(F.col(VID) + 1, F.col("up"))
        opens = F.col(VID) % self.size == 0  # a chunk's first vertex also carries the leading 0
        return ids.withColumn("up", up).select("part", F.inline(F.when(opens, F.array(place(F.col(VID), F.lit(0)), after)).otherwise(F.array(after))))

    def write_offsets(self, part: int | None = None) -> None:
        if not self.layout.ordered:
            raise ValueError("only ordered layouts have offsets")
        df = self.offsets(part).withColumnRenamed("offset", self.reserved.offset)
        name_of = partial(paths.offset_chunk, self.prefix, self.info, self.layout)
        base = paths.offset_folder(self.prefix, self.info, self.layout)
        write_chunks(df, ["part"], [VID], [self.reserved.offset], self.adj.file_type, base, name_of, self.replace, len(self.counts) if part is None else 1, self.size + 1)

    def _write_topology(self) -> None:
        df = self.rows.withColumnsRenamed({SRC: self.reserved.src, DST: self.reserved.dst})
        name_of = partial(paths.adj_chunk, self.prefix, self.info, self.layout)
        base, columns = paths.adj_folder(self.prefix, self.info, self.layout), [self.reserved.src, self.reserved.dst]
        write_chunks(df, ["__part", "__chunk"], ["__place"], columns, self.adj.file_type, base, name_of, self.replace, self.chunks, self.info.chunk_size)

    def write_adj_list(self) -> None:
        """Adjacency, offsets if the layout is ordered, then counts."""
        self._write_topology()
        if self.layout.ordered:
            self.write_offsets()
        self.write_edge_counts()

    def _write_group(self, g: PropertyGroup) -> None:
        if g not in self.info.property_groups:
            raise KeyError("no such property group")
        name_of = partial(paths.edge_group_chunk, self.prefix, self.info, self.layout, g)
        base = paths.edge_group(self.prefix, self.info, self.layout, g)
        write_chunks(self.rows, ["__part", "__chunk"], ["__place"], g.names, g.file_type, base, name_of, self.replace, self.chunks, self.info.chunk_size)

    def write_edge_properties(self, group: PropertyGroup | None = None) -> None:
        side_by_side(*[partial(self._write_group, g) for g in (self.info.property_groups if group is None else [group])])

    def write_edges(self) -> None:
        """Properties, adjacency and offsets at the same time, then counts."""
        jobs = [partial(self._write_group, g) for g in self.info.property_groups]
        side_by_side(*jobs, self._write_topology, *([self.write_offsets] if self.layout.ordered else []))
        self.write_edge_counts()


READY = "ready.json"


def _rewrite_folder(prefix: str, info: EdgeInfo, layout: AdjListType, part: int) -> str:
    return f"{paths.layout_folder(prefix, info, layout)}.rewrite-part{part}/"


def rewrite_edge_partition(
    prefix: str, info: EdgeInfo, layout: AdjListType | str, part: int, df: DataFrame, count: int, reserved: Reserved | None = None
) -> None:
    """Rewrite one vertex chunk's edges: adjacency, properties, its offset chunk and its count; other parts stay as they are.

    Everything is written into a hidden folder first. Then a record of the moves commits the rewrite, and files are swapped in; what they replace is moved
    aside and deleted last. A crash before the record leaves the old part; after it, `finish_rewrites` (or the next rewrite of the part) completes the swap.
    """
    layout, spark = AdjListType(layout), df.sparkSession
    store, folder = Store(spark), _rewrite_folder(prefix, info, layout, part)
    _finish(store, prefix, folder)
    mine = df.where(F.floor(F.col(SRC if layout.by_source else DST) / info.aligned_chunk(layout)) == part)
    w = EdgeWriter(folder, info, layout, count, mine, ValidateLevel.WEAK, WriteMode.OVERWRITE, reserved)
    jobs = [partial(w._write_group, g) for g in info.property_groups]
    side_by_side(*jobs, w._write_topology, *([partial(w.write_offsets, part)] if layout.ordered else []))
    w.write_edge_count(part, w.counts[part])
    made = [lambda at: paths.adj_part(at, info, layout, part)]
    made += [lambda at, g=g: paths.edge_group_part(at, info, layout, g, part) for g in info.property_groups]
    made += [lambda at: paths.offset_chunk(at, info, layout, part)] if layout.ordered else []
    made += [lambda at: paths.edge_count(at, info, layout, part)]
    moves = [name("").rstrip("/") for name in made]
    gone = [m for m in moves if not store.exists(folder + m)]  # a part without edges has no chunks
    store.write_text(f"{folder}.{READY}", json.dumps({"moves": moves, "gone": gone}))
    store.rename(f"{folder}.{READY}", folder + READY)
    _finish(store, prefix, folder)


def _finish(store: Store, prefix: str, folder: str) -> None:
    """Complete a committed rewrite; drop one that wasn't committed. Each step can be repeated."""
    if not store.exists(folder):
        return
    if store.exists(folder + READY):
        plan = json.loads(store.read_text(folder + READY))
        for name in plan["moves"]:
            if name in plan["gone"]:
                store.delete(prefix + name)
            elif store.exists(folder + name):
                store.rename(folder + name, prefix + name)
            place, _, last = (prefix + name).rpartition("/")
            for path, _, _ in store.list(place):  # what a crash left aside
                if path.rsplit("/", 1)[1].startswith(f".{last}.old-"):
                    store.delete(path)
        store.delete(folder + READY)
    store.delete(folder)


def finish_rewrites(spark: SparkSession, prefix: str, info: EdgeInfo, layout: AdjListType | str) -> None:
    """After a crash: complete or drop the rewrites of a layout that were under way. Nobody may be rewriting it meanwhile."""
    store = Store(spark)
    for path, is_dir, _ in store.list(paths.layout_folder(prefix, info, AdjListType(layout))):
        if is_dir and path.rsplit("/", 1)[1].startswith(".rewrite-part"):
            _finish(store, prefix, path.rstrip("/") + "/")


class GraphWriter:
    """Collects frames of a graph and writes them with ids made from primary keys."""

    def __init__(self, reserved: Reserved | None = None):
        self.vertices: dict[str, tuple[DataFrame, str]] = {}
        self.edges: dict[tuple[str, str, str], DataFrame] = {}
        self.reserved = reserved or Reserved()

    def put_vertex_data(self, type_: str, df: DataFrame, primary_key: str = "") -> None:
        """The key is the first column unless named; a type can be put once."""
        if type_ in self.vertices:
            raise ValueError(f"vertex type {type_} was put before")
        key = primary_key or df.columns[0]
        if key not in df.columns:
            raise ValueError(f"the frame lacks its primary key {key}")
        self.vertices[type_] = df, key

    def put_edge_data(self, triplet: tuple[str, str, str], df: DataFrame) -> None:
        """The first two columns are the primary keys of the ends."""
        if triplet in self.edges:
            raise ValueError(f"edge type {triplet} was put before")
        self.edges[triplet] = df

    def write(self, spark: SparkSession, path: str, name: str, vertex_chunk: int = VERTEX_CHUNK, edge_chunk: int = EDGE_CHUNK, file_type: str = "parquet", version: str = "ql/v1") -> GraphInfo:
        """With metadata made from the frames, saved in the same folder."""
        return self.write_with_graph_info(spark, infer_graph_info(name, self.vertices, self.edges, vertex_chunk, edge_chunk, file_type, version), path)

    def write_with_graph_info(self, spark: SparkSession, info: GraphInfo, path: str, level: ValidateLevel = ValidateLevel.WEAK, strict: bool = False, save: bool = True) -> GraphInfo:
        """strict: an edge whose end isn't a vertex is an error; otherwise it is left out."""
        if bad := info.issues():
            raise ValueError("; ".join(bad))
        prefix = path.rstrip("/") + "/"
        counts, maps = {}, {}
        for v in info.vertices:
            if v.type not in self.vertices:
                raise KeyError(f"no frame was put for {v.type}")
            df, key = self.vertices[v.type]
            if df.schema[key].dataType.simpleString() != v.get_property(key).spark_type().simpleString():
                raise TypeError(f"the key {key} differs from the metadata")
            indexed, mapping = IndexGenerator.vertex_index_and_mapping(df, key)
            counts[v.type], maps[v.type] = indexed.count(), mapping
            VertexWriter(prefix, v, indexed, counts[v.type], level, WriteMode.OVERWRITE, self.reserved).write()
        for e in info.edges:
            if e.triplet not in self.edges:
                raise KeyError(f"no frame was put for {e.triplet}")
            df = self.edges[e.triplet]
            ids = IndexGenerator.edges_by_mapping(df, maps[e.src_type], maps[e.dst_type], strict=strict)
            for a in e.adj_lists:
                EdgeWriter(prefix, e, a.layout, counts[e.src_type if a.layout.by_source else e.dst_type], ids, level, WriteMode.OVERWRITE, self.reserved).write_edges()
        if save:
            info.save(spark, prefix)
        return info


class VerticesBuilder:
    """Vertices added one by one, then dumped; for tests and small graphs."""

    def __init__(self, info: VertexInfo, prefix: str, spark: SparkSession, level: ValidateLevel = ValidateLevel.STRONG):
        self.info, self.prefix, self.spark, self.level, self.rows = info, prefix, spark, level, []

    def add_vertex(self, **properties) -> int:
        for name in properties:
            self.info.get_property(name)
        self.rows.append(properties)
        return len(self.rows) - 1

    def add_property_column(self, name: str, values: Sequence) -> None:
        """One value for each vertex added so far."""
        self.info.get_property(name)
        if len(values) != len(self.rows):
            raise ValueError(f"{len(values)} values for {len(self.rows)} vertices")
        for row, value in zip(self.rows, values, strict=True):
            row[name] = value

    def num(self) -> int:
        return len(self.rows)

    def frame(self) -> DataFrame:
        from ..sources.readers import schema_of

        schema = schema_of(self.info.property_groups, VID)
        return self.spark.createDataFrame([(i, *[r.get(f.name) for f in schema.fields[1:]]) for i, r in enumerate(self.rows)], schema)

    def dump(self) -> None:
        VertexWriter(self.prefix, self.info, self.frame(), len(self.rows), self.level).write()


class EdgesBuilder:
    """Edges added one by one by their ends' ids, then dumped in one layout."""

    def __init__(self, info: EdgeInfo, prefix: str, layout: AdjListType | str, count: int, spark: SparkSession, level: ValidateLevel = ValidateLevel.STRONG):
        self.info, self.prefix, self.layout, self.count, self.spark, self.level, self.rows = info, prefix, AdjListType(layout), count, spark, level, []

    def add_edge(self, src: int, dst: int, **properties) -> None:
        for name in properties:
            self.info.get_property(name)
        self.rows.append((src, dst, properties))

    def num(self) -> int:
        return len(self.rows)

    def frame(self) -> DataFrame:
        from ..sources.readers import schema_of

        schema = schema_of(self.info.property_groups, SRC, DST)
        return self.spark.createDataFrame([(s, d, *[p.get(f.name) for f in schema.fields[2:]]) for s, d, p in self.rows], schema)

    def dump(self) -> None:
        EdgeWriter(self.prefix, self.info, self.layout, self.count, self.frame(), self.level).write_edges()
