"""Readers of an archive's vertices, edges and whole graphs; everything they return is a lazy DataFrame.

Frames have the columns vid, or src and dst, and properties by their names; edge frames have eid if asked for. Only the property groups that hold
asked-for columns are opened. Several groups are read side by side, chunk by chunk, without a shuffle (see `aligned`). Where that can't be, groups of vertices
are joined on their id and groups of edges, which have no key of their own, by part, chunk and place in the file; formats other than
Parquet don't tell the place, so their chunks are then read one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..plans import paths
from ..plans.info import EdgeInfo, GraphInfo, PropertyGroup, VertexInfo, load_graph_info
from ..plans.types import DST, EID, LABELS, SRC, VID, AdjListType, FileType, plain_names
from ..session import POOL, Store
from .aligned import Chunks, Files, can_align, side_by_side
from .control import read_value

PLACE = ("__part", "__chunk", "__row")


def read_files(spark: SparkSession, kind: FileType, path: str | list[str], schema: T.StructType | None = None, deep: bool = False) -> DataFrame:
    """Files of one type, named chunk0, chunk1, ... without an extension."""
    reader = spark.read.option("recursiveFileLookup", "true") if deep else spark.read
    if kind is FileType.CSV:
        reader = reader.option("header", "true")
    if schema is not None and kind in (FileType.CSV, FileType.JSON):
        reader = reader.schema(schema)
    return reader.format(kind.value).load(path)


def schema_of(groups: Iterable[PropertyGroup], *reserved: str) -> T.StructType:
    fields = [T.StructField(r, T.LongType()) for r in reserved]
    return T.StructType(fields + [T.StructField(p.name, p.spark_type()) for g in groups for p in g.properties])


class VertexReader:
    """Reads one vertex type under a prefix."""

    def __init__(self, prefix: str, info: VertexInfo, spark: SparkSession):
        self.prefix, self.info, self.spark = prefix, info, spark

    def read_vertices_number(self) -> int:
        """From the control file, without a scan."""
        return read_value(self.spark, paths.vertex_count(self.prefix, self.info))

    def read_vertex_chunk_number(self) -> int:
        return paths.chunk_count(self.read_vertices_number(), self.info.chunk_size)

    def _side_by_side(self, groups: Sequence[PropertyGroup], chunks: range | None = None, columns: Sequence[str] | None = None, labels: bool = False) -> DataFrame | None:
        """Several groups, and the label columns, read chunk by chunk; None where the files can't be read that way."""
        chunks = range(self.read_vertex_chunk_number()) if chunks is None else chunks
        if len(groups) + labels < 2 or not chunks:
            return None
        asked = [[n for n in g.names if columns is None or n in columns] for g in groups]
        files = [Files(paths.vertex_group(self.prefix, self.info, g), g.file_type, tuple((n, n) for n in names)) for g, names in zip(groups, asked, strict=True)]
        files[0] = Files(files[0].folder, files[0].kind, (("*VertexIndex", VID), *files[0].columns))
        fields = [T.StructField(VID, T.LongType())]
        fields += [T.StructField(p.name, p.spark_type()) for g, names in zip(groups, asked, strict=True) for p in g.properties if p.name in names]
        if labels:
            files.append(Files(paths.label_folder(self.prefix, self.info), FileType.PARQUET, tuple((x, f"__{x}") for x in self.info.labels)))
            fields += [T.StructField(f"__{x}", T.BooleanType()) for x in self.info.labels]
        if not can_align(files, T.StructType(fields), f"{files[0].folder}chunk{chunks.start}"):
            return None
        which = Chunks((None,), (len(chunks),), (0,), self.info.chunk_size, chunks.start)
        return side_by_side(self.spark, files, which, T.StructType(fields))

    def _load(self, g: PropertyGroup, path: str | list[str]) -> DataFrame:
        if g.file_type in (FileType.CSV, FileType.JSON):
            first = path if isinstance(path, str) else path[0]
            head = Store(self.spark).list(first)
            name = _reserved_name(self.spark, g.file_type, next((p for p, d, _ in head if not d), first), "VertexIndex")
            df = read_files(self.spark, g.file_type, path, schema_of([g], name) if g.file_type is FileType.JSON else None)
            if g.file_type is FileType.CSV:
                df = df.select(*[F.col(f"`{c}`").cast(g_type) for c, g_type in [(name, T.LongType()), *[(p.name, p.spark_type()) for p in g.properties]]])
        else:
            df = read_files(self.spark, g.file_type, path)
        return plain_names(df)

    def read_vertex_property_chunk(self, g: PropertyGroup, chunk: int) -> DataFrame:
        self._check(g)
        if not 0 <= chunk < self.read_vertex_chunk_number():
            raise IndexError(f"no chunk {chunk} of {self.info.type}")
        return self._load(g, paths.vertex_chunk(self.prefix, self.info, g, chunk))

    def read_vertex_property_group(self, g: PropertyGroup) -> DataFrame:
        self._check(g)
        if not self.read_vertices_number():
            return self.spark.createDataFrame([], schema_of([g], VID))
        return self._load(g, paths.vertex_group(self.prefix, self.info, g))

    def read_multiple_vertex_property_groups(self, groups: Sequence[PropertyGroup]) -> DataFrame:
        """The id is kept once."""
        if not groups:
            raise ValueError("no property group")
        for g in groups:
            self._check(g)
        side = self._side_by_side(groups)
        return side if side is not None else reduce(lambda a, b: a.join(b, VID), [self.read_vertex_property_group(g) for g in groups])

    def read_all_vertex_property_groups(self, columns: Iterable[str] | None = None) -> DataFrame:
        """All groups; with columns, those columns and the id, from the groups that hold them alone."""
        if columns is not None and not (columns := list(columns)):
            return self.ids()
        groups = self.info.groups_of(columns)
        df = self._side_by_side(groups, None, columns)
        df = self.read_multiple_vertex_property_groups(groups) if df is None else df
        return df if columns is None else df.select(VID, *columns)

    def ids(self) -> DataFrame:
        return self.spark.range(self.read_vertices_number()).withColumnRenamed("id", VID)

    def read_vertices(self, ids: Sequence[int], columns: Iterable[str] | None = None) -> DataFrame:
        """Properties of many vertices, ascending: duplicates collapse and any id out of range is an error.

        Only the chunks that hold the ids are opened."""
        n, wanted = self.read_vertices_number(), sorted(set(ids))
        if not wanted:
            return self.read_all_vertex_property_groups(columns).limit(0)
        if wanted[0] < 0 or wanted[-1] >= n:
            raise IndexError(f"{self.info.type} has ids from 0 to {n - 1}")
        chunks = sorted({i // self.info.chunk_size for i in wanted})
        columns = None if columns is None else list(columns)
        if columns == []:
            frames = [self.ids()]
        else:
            frames = [self._load(g, [paths.vertex_chunk(self.prefix, self.info, g, c) for c in chunks]) for g in self.info.groups_of(columns)]
        df = reduce(lambda a, b: a.join(b, VID), frames)
        keys = self.spark.createDataFrame([(i,) for i in wanted], f"{VID} long")
        df = df.where(F.col(VID).between(wanted[0], wanted[-1])).join(keys, VID, "left_semi")
        return (df if columns is None else df.select(VID, *columns)).orderBy(VID)

    def properties(self, vid: int, columns: Iterable[str] | None = None) -> DataFrame:
        return self.read_vertices([vid], columns)

    def read_vertex_labels(self) -> DataFrame:
        """(vid, :LABEL array<string>); the id is the row's place in its chunk."""
        if not self.info.labels:
            raise ValueError(f"{self.info.type} has no labels")
        return labels_as_array(self.read_label_columns(), self.info.labels)

    def read_label_columns(self, labels: Sequence[str] | None = None) -> DataFrame:
        """(vid, a boolean column for each label); labels that the type lacks are errors."""
        labels = list(self.info.labels if labels is None else labels)
        for label in labels:
            if label not in self.info.labels:
                raise KeyError(f"{self.info.type} has no label {label}")
        if not self.read_vertices_number():
            return self.spark.createDataFrame([], T.StructType([T.StructField(VID, T.LongType()), *[T.StructField(x, T.BooleanType()) for x in labels]]))
        df = read_files(self.spark, FileType.PARQUET, paths.label_folder(self.prefix, self.info))
        chunk = F.regexp_extract(F.col("_metadata.file_path"), r"chunk(\d+)$", 1).cast("long")
        return df.select((chunk * self.info.chunk_size + F.col("_metadata.row_index")).alias(VID), *[F.col(f"`{x}`") for x in labels])

    def read_vertex_with_labels(self, columns: Iterable[str] | None = None) -> DataFrame:
        """Properties with labels, or the plain frame for a type without labels."""
        columns = None if columns is None else list(columns)
        if not self.info.labels:
            return self.read_all_vertex_property_groups(columns)
        side = None if columns == [] else self._side_by_side(self.info.groups_of(columns), None, columns, True)
        if side is None:
            return self.read_all_vertex_property_groups(columns).join(self.read_vertex_labels(), VID, "left")
        names = [p.name for g in self.info.groups_of(None) for p in g.properties] if columns is None else columns
        held = F.array_compact(F.array(*[F.when(F.col(f"`__{x}`"), F.lit(x)) for x in self.info.labels])).alias(LABELS)
        return side.select(VID, *[F.col(f"`{n}`") for n in names], held)

    def scan(self, columns: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
        """In order of ids, at most limit rows; with a limit only the chunks that hold the first rows are opened."""
        if limit is None:
            return self.read_all_vertex_property_groups(columns).orderBy(VID)
        return self.row_range(0, limit, columns).orderBy(VID)

    def read_chunks(self, chunks: Iterable[int], columns: Iterable[str] | None = None) -> DataFrame:
        """The vertices of some chunks; the others' files aren't opened."""
        columns, wanted = None if columns is None else list(columns), sorted(set(chunks))
        groups = self.info.groups_of(columns)
        if not wanted:
            return self.read_all_vertex_property_groups(columns).limit(0)
        if wanted[0] < 0 or wanted[-1] >= self.read_vertex_chunk_number():
            raise IndexError(f"{self.info.type} has {self.read_vertex_chunk_number()} chunks")
        frames = [self._load(g, [paths.vertex_chunk(self.prefix, self.info, g, c) for c in wanted]) for g in groups]
        df = reduce(lambda a, b: a.join(b, VID), frames)
        return df if columns is None else df.select(VID, *columns)

    def row_range(self, first: int, end: int, columns: Iterable[str] | None = None) -> DataFrame:
        """Vertices with first <= vid < end, from the chunks that hold them."""
        n = self.read_vertices_number()
        first, end = max(0, first), min(end, n)
        if first >= end:
            return self.read_all_vertex_property_groups(columns).limit(0)
        chunks = range(first // self.info.chunk_size, (end - 1) // self.info.chunk_size + 1)
        columns = None if columns is None else list(columns)
        if columns == []:
            return self.spark.range(first, end).withColumnRenamed("id", VID)
        df = self._side_by_side(self.info.groups_of(columns), chunks, columns)
        df = self.read_chunks(chunks, columns) if df is None else df
        df = df.where((F.col(VID) >= first) & (F.col(VID) < end))
        return df if columns is None else df.select(VID, *columns)

    def _check(self, g: PropertyGroup) -> None:
        if g not in self.info.property_groups:
            raise KeyError(f"{self.info.type} has no such property group")


def labels_as_array(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.select(VID, F.array_compact(F.array(*[F.when(F.col(f"`{x}`"), F.lit(x)) for x in labels])).alias(LABELS))


def _reserved_name(spark: SparkSession, kind: FileType, path: str, ending: str) -> str:
    """The reserved column's name in a text file, whose prefix is the writer's own."""
    import re

    head = spark.read.text(path).limit(1).collect()
    m = re.search(rf"_[A-Za-z]+?{ending}", head[0][0] if head else "")
    return m[0] if m else f"_ql{ending}"


class EdgeReader:
    """Reads one layout of an edge type under a prefix."""

    def __init__(self, prefix: str, info: EdgeInfo, layout: AdjListType | str, spark: SparkSession):
        self.prefix, self.info, self.spark = prefix, info, spark
        self.layout = AdjListType(layout)
        self.adj = info.adj_list(self.layout)
        self.aligned = SRC if self.layout.by_source else DST

    # counts

    def read_vertices_number(self) -> int:
        """Of the aligned vertex type."""
        return read_value(self.spark, paths.edge_vertex_count(self.prefix, self.info, self.layout))

    def read_vertex_chunk_number(self) -> int:
        return paths.chunk_count(self.read_vertices_number(), self.info.aligned_chunk(self.layout))

    def read_edges_number(self, part: int | None = None) -> int:
        """Of one vertex chunk, or of all; from control files."""
        return sum(self.edge_counts()) if part is None else read_value(self.spark, paths.edge_count(self.prefix, self.info, self.layout, part))

    def edge_counts(self) -> list[int]:
        """Of every vertex chunk; the small files are read side by side."""
        files = [paths.edge_count(self.prefix, self.info, self.layout, p) for p in range(self.read_vertex_chunk_number())]
        store = Store(self.spark)
        return list(POOL.map(lambda f: read_value(self.spark, f, store), files))

    def _parts(self, part: int | Iterable[int] | None) -> list[int]:
        """The vertex chunks of a number, some numbers or all, that have edges."""
        n = self.read_vertex_chunk_number()
        asked = None if part is None else [part] if isinstance(part, int) else sorted(set(part))
        if asked is not None and any(not 0 <= p < n for p in asked):
            raise IndexError(f"{self.info.name} has {n} vertex chunks")
        if asked is not None and len(asked) < 16:
            return [p for p in asked if self.read_edges_number(p)]
        keep = None if asked is None else set(asked)
        return [p for p, edges in enumerate(self.edge_counts()) if edges and (keep is None or p in keep)]

    # chunks

    def _chunks(self, folder: str) -> list[str]:
        found = [p for p, is_dir, _ in Store(self.spark).list(folder) if not is_dir and p.rsplit("/", 1)[1].startswith("chunk")]
        return sorted(found, key=lambda p: int(p.rsplit("chunk", 1)[1]))

    def _load(self, kind: FileType, files: list[str] | str, groups: Sequence[PropertyGroup] | None, placed: bool) -> DataFrame:
        """Files of adjacency (groups None) or of a property group; placed: with columns that tell the row."""
        text = kind in (FileType.CSV, FileType.JSON)
        names: list[str] = []
        if text and groups is None:
            first = files if isinstance(files, str) else files[0]
            names = [_reserved_name(self.spark, kind, first, e) for e in ("SrcIndex", "DstIndex")]
        schema = schema_of(groups or (), *names) if text else None
        path = F.col("_metadata.file_path")
        part = F.substring_index(F.substring_index(path, "/part", -1), "/", 1).cast("long")
        chunk = F.substring_index(path, "/chunk", -1).cast("long")
        if not placed:
            return plain_names(read_files(self.spark, kind, files, schema))
        if kind is FileType.PARQUET:
            df = read_files(self.spark, kind, files)
            return plain_names(df.select("*", part.alias(PLACE[0]), chunk.alias(PLACE[1]), F.col("_metadata.row_index").alias(PLACE[2])))
        # other formats don't tell the row; a chunk that is one task does, by the order of its rows
        each = [files] if isinstance(files, str) else files
        frames = []
        for f in each:
            df = read_files(self.spark, kind, f, schema)
            frames.append(df.select("*", part.alias(PLACE[0]), chunk.alias(PLACE[1])).coalesce(1).withColumn(PLACE[2], F.monotonically_increasing_id()))
        return plain_names(reduce(DataFrame.unionByName, frames))

    def _empty(self, groups: Sequence[PropertyGroup] | None) -> DataFrame:
        return self.spark.createDataFrame([], schema_of(groups or (), *([SRC, DST] if groups is None else []), *PLACE))

    def _all(self, kind: FileType, folder_of, groups, part: int | None, placed: bool) -> DataFrame:
        parts = self._parts(part)
        if not parts:
            df = self._empty(groups)
            return df if placed else df.drop(*PLACE)
        if kind is FileType.PARQUET or not placed:
            return self._load(kind, [folder_of(p) for p in parts], groups, placed)
        # no format but Parquet tells a row's place
        return self._load(kind, [f for p in parts for f in self._chunks(folder_of(p))], groups, placed)

    def _group_frame(self, g: PropertyGroup, part: int | None, placed: bool) -> DataFrame:
        if g not in self.info.property_groups:
            raise KeyError(f"{self.info.name} has no such property group")
        return self._all(g.file_type, lambda p: paths.edge_group_part(self.prefix, self.info, self.layout, g, p), [g], part, placed)

    def _adj_frame(self, part: int | None, placed: bool) -> DataFrame:
        return self._all(self.adj.file_type, lambda p: paths.adj_part(self.prefix, self.info, self.layout, p), None, part, placed)

    #: Vertex chunks up to which their starts (two longs each) are broadcast.
    MAX_BROADCAST_PARTS = 1_000_000

    def _starts(self) -> list[int]:
        """For each part how many edges the parts before it have."""
        return [0, *accumulate(self.edge_counts())][:-1]

    def _numbered(self, df: DataFrame, part: int | Iterable[int] | None, add_index: bool) -> DataFrame:
        """eid: the row's place in its part after all edges of the parts before, or its place in the one part."""
        if add_index:
            size = F.lit(self.info.chunk_size).cast("long")
            eid = F.col(PLACE[1]) * size + F.col(PLACE[2])
            if not isinstance(part, int):
                table = self.spark.createDataFrame(list(enumerate(self._starts())), f"{PLACE[0]} long, __before long")  # a row a vertex chunk
                df = df.join(F.broadcast(table) if self.read_vertex_chunk_number() <= self.MAX_BROADCAST_PARTS else table, PLACE[0])
                eid = eid + F.col("__before")
            df = df.withColumn(EID, eid).drop("__before")
        return df.drop(*PLACE)

    def read_offset(self, part: int) -> DataFrame:
        """(vid, offset) of one vertex chunk; vid counts one past the chunk's last vertex. Ordered layouts only."""
        if not self.layout.ordered:
            raise ValueError("only ordered layouts have offsets")
        path = paths.offset_chunk(self.prefix, self.info, self.layout, part)
        size = self.info.aligned_chunk(self.layout)
        if self.adj.file_type is FileType.PARQUET:
            df = plain_names(read_files(self.spark, FileType.PARQUET, path).select("*", F.col("_metadata.row_index").alias("__row")))
        else:
            df = plain_names(read_files(self.spark, self.adj.file_type, path)).coalesce(1).withColumn("__row", F.monotonically_increasing_id())
        return df.select((F.col("__row") + part * size).alias(VID), F.col("offset").cast("long").alias("offset"))

    def read_offsets(self) -> DataFrame:
        """(chunk, vid, offset) of all vertex chunks, read as one folder."""
        if not self.layout.ordered:
            raise ValueError("only ordered layouts have offsets")
        n = self.read_vertex_chunk_number()
        if not n:
            return self.spark.createDataFrame([], f"chunk long, {VID} long, offset long")
        if self.adj.file_type is not FileType.PARQUET:  # no other format tells a row's place
            frames = [self.read_offset(p).select(F.lit(p).cast("long").alias("chunk"), VID, "offset") for p in range(n)]
            return reduce(DataFrame.unionByName, frames)
        df = read_files(self.spark, FileType.PARQUET, paths.offset_folder(self.prefix, self.info, self.layout))
        chunk = F.substring_index(F.col("_metadata.file_path"), "/chunk", -1).cast("long")
        df = plain_names(df.select("*", chunk.alias("chunk"), F.col("_metadata.row_index").alias("__row")))
        at = F.col("chunk") * self.info.aligned_chunk(self.layout) + F.col("__row")
        return df.select("chunk", at.alias(VID), F.col("offset").cast("long").alias("offset"))

    def offset_range(self, vid: int) -> tuple[int, int]:
        """First and end place of a vertex's edges in its part."""
        n, size = self.read_vertices_number(), self.info.aligned_chunk(self.layout)
        if not 0 <= vid < n:
            raise IndexError(f"ids run from 0 to {n - 1}")
        rows = {r[0]: r[1] for r in self.read_offset(vid // size).where(F.col(VID).isin(vid, vid + 1)).collect()}
        return rows[vid], rows[vid + 1]

    def read_adj_list_chunk(self, part: int, chunk: int) -> DataFrame:
        return self._load(self.adj.file_type, paths.adj_chunk(self.prefix, self.info, self.layout, part, chunk), None, False)

    def read_adj_list_for_vertex_chunk(self, part: int, add_index: bool = True) -> DataFrame:
        return self._numbered(self._adj_frame(part, add_index), part, add_index)

    def read_all_adj_list(self, add_index: bool = True) -> DataFrame:
        return self._numbered(self._adj_frame(None, add_index), None, add_index)

    def read_edge_property_chunk(self, g: PropertyGroup, part: int, chunk: int) -> DataFrame:
        return self._load(g.file_type, paths.edge_group_chunk(self.prefix, self.info, self.layout, g, part, chunk), [g], False)

    def read_edge_property_group_for_vertex_chunk(self, g: PropertyGroup, part: int, add_index: bool = True) -> DataFrame:
        return self._numbered(self._group_frame(g, part, add_index), part, add_index)

    def read_edge_property_group(self, g: PropertyGroup, add_index: bool = True) -> DataFrame:
        return self._numbered(self._group_frame(g, None, add_index), None, add_index)

    def _groups(self, groups: Sequence[PropertyGroup], part: int | Iterable[int] | None, add_index: bool, adjacency: bool, columns: Sequence[str] | None = None) -> DataFrame:
        if not groups and not adjacency:
            raise ValueError("no property group")
        if any(g not in self.info.property_groups for g in groups):
            raise KeyError(f"{self.info.name} has no such property group")
        single = len(groups) + adjacency == 1
        if not single and (side := self._side_by_side(groups, part, add_index, adjacency, columns)) is not None:
            return side
        frames = [self._adj_frame(part, add_index or not single)] if adjacency else []
        frames += [self._group_frame(g, part, add_index or not single) for g in groups]
        df = reduce(lambda a, b: a.join(b, list(PLACE)), frames)
        return self._numbered(df, part, add_index)

    def _files(self, groups: Sequence[PropertyGroup], adjacency: bool, columns: Sequence[str] | None) -> tuple[list[Files], T.StructType]:
        files, fields = [], []
        if adjacency:
            files.append(Files(paths.adj_folder(self.prefix, self.info, self.layout), self.adj.file_type, (("*SrcIndex", SRC), ("*DstIndex", DST))))
            fields += [T.StructField(SRC, T.LongType()), T.StructField(DST, T.LongType())]
        for g in groups:
            kept = [p for p in g.properties if columns is None or p.name in columns]
            files.append(Files(paths.edge_group(self.prefix, self.info, self.layout, g), g.file_type, tuple((p.name, p.name) for p in kept)))
            fields += [T.StructField(p.name, p.spark_type()) for p in kept]
        return files, T.StructType(fields)

    def _side_by_side(self, groups, part, add_index: bool, adjacency: bool, columns: Sequence[str] | None) -> DataFrame | None:
        """The groups read chunk by chunk; None where the files can't be read that way."""
        files, schema = self._files(groups, adjacency, columns)
        local = isinstance(part, int)
        if local:
            n = self._parts(part) and self.read_edges_number(part)
            parts, edges, starts = ([part], [n], [0]) if n else ([], [], [])
        else:
            counts = self.edge_counts()
            keep = range(len(counts)) if part is None else sorted(set(part))
            if any(not 0 <= p < len(counts) for p in keep):
                raise IndexError(f"{self.info.name} has {len(counts)} vertex chunks")
            before = [0, *accumulate(counts)]
            parts = [p for p in keep if counts[p]]
            edges, starts = [counts[p] for p in parts], [before[p] for p in parts]
        if not parts or not can_align(files, schema, f"{files[0].folder}part{parts[0]}/chunk0"):
            return None
        which = Chunks(tuple(parts), tuple(paths.chunk_count(n, self.info.chunk_size) for n in edges), tuple(starts), self.info.chunk_size)
        return side_by_side(self.spark, files, which, schema, EID if add_index else None)

    def _some_chunks(self, part: int, chunks: range, columns: Sequence[str] | None) -> DataFrame:
        """Edges of some chunks of one part, with eid as their place in the part; no other file is opened."""
        groups = self.info.groups_of(columns) if columns is None or columns else []
        files, schema = self._files(groups, True, columns)
        if can_align(files, schema, f"{files[0].folder}part{part}/chunk{chunks.start}"):
            which = Chunks((part,), (len(chunks),), (0,), self.info.chunk_size, chunks.start)
            return side_by_side(self.spark, files, which, schema, EID)
        frames = [self._load(self.adj.file_type, [paths.adj_chunk(self.prefix, self.info, self.layout, part, c) for c in chunks], None, True)]
        for g in groups:
            frames.append(self._load(g.file_type, [paths.edge_group_chunk(self.prefix, self.info, self.layout, g, part, c) for c in chunks], [g], True))
        return self._numbered(reduce(lambda a, b: a.join(b, list(PLACE)), frames), part, True)

    def read_multiple_edge_property_groups_for_vertex_chunk(self, groups: Sequence[PropertyGroup], part: int, add_index: bool = True) -> DataFrame:
        return self._groups(groups, part, add_index, False)

    def read_multiple_edge_property_groups(self, groups: Sequence[PropertyGroup], add_index: bool = True) -> DataFrame:
        return self._groups(groups, None, add_index, False)

    def read_all_edge_property_groups_for_vertex_chunk(self, part: int, add_index: bool = True) -> DataFrame:
        return self._groups(self.info.property_groups, part, add_index, False)

    def read_all_edge_property_groups(self, add_index: bool = True) -> DataFrame:
        return self._groups(self.info.property_groups, None, add_index, False)

    def read_edges_for_vertex_chunk(self, part: int, add_index: bool = True, columns: Iterable[str] | None = None) -> DataFrame:
        return self._edges(part, add_index, columns)

    def read_edges(self, add_index: bool = True, columns: Iterable[str] | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """Adjacency with properties; with columns, only from the groups that hold them; with parts, only of those vertex chunks."""
        return self._edges(None if parts is None else list(parts), add_index, columns)

    def _edges(self, part: int | list[int] | None, add_index: bool, columns: Iterable[str] | None) -> DataFrame:
        columns = None if columns is None else list(columns)
        groups = self.info.groups_of(columns) if columns is None or columns else []
        df = self._groups(groups, part, add_index, True, columns)
        return df if columns is None else df.select(SRC, DST, *([EID] if add_index else []), *columns)

    def edges_of(self, vid: int, columns: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
        """Edges of one aligned vertex in stored order; an id out of range is an error.

        In an ordered layout the offsets tell which chunks hold them, and no other file is opened; an unordered one reads the vertex chunk.
        """
        n = self.read_vertices_number()
        if not 0 <= vid < n:
            raise IndexError(f"ids run from 0 to {n - 1}")
        part, columns = vid // self.info.aligned_chunk(self.layout), None if columns is None else list(columns)
        if not self.layout.ordered:
            df = self.read_edges_for_vertex_chunk(part, True, columns).where(F.col(self.aligned) == vid).orderBy(EID)
            return df if limit is None else df.limit(limit)
        first, end = self.offset_range(vid)
        end = end if limit is None else min(end, first + limit)
        if first >= end:
            return self.read_edges_for_vertex_chunk(part, True, columns).limit(0)
        size = self.info.chunk_size
        df = self._some_chunks(part, range(first // size, (end - 1) // size + 1), columns)
        df = df.where((F.col(EID) >= first) & (F.col(EID) < end)).orderBy(EID)
        return df if columns is None else df.select(SRC, DST, EID, *columns)

    def neighbors(self, vid: int, limit: int | None = None) -> DataFrame:
        """Ids at the other end of one aligned vertex's edges, in stored order, which is ascending in an ordered layout."""
        other = DST if self.layout.by_source else SRC
        return self.edges_of(vid, [], limit).orderBy(EID).select(other)

    def scan(self, columns: Iterable[str] | None = (), limit: int | None = None, part: int | None = None) -> DataFrame:
        """Edges in stored order; by default the topology alone. With a limit only the first chunks that hold so many edges are opened."""
        columns = None if columns is None else list(columns)
        if limit is None:
            return self._edges(part, True, columns).orderBy(EID)
        left, frames = limit, []
        counts = [self.read_edges_number(part)] if part is not None else self.edge_counts()
        before = [0, *accumulate(counts)]
        for i, n in enumerate(counts):
            if left <= 0:
                break
            if n:
                df = self._some_chunks(i if part is None else part, range(paths.chunk_count(min(left, n), self.info.chunk_size)), columns)
                frames.append(df.withColumn(EID, F.col(EID) + before[i]))
                left -= n
        if not frames:
            return self._edges(part, True, columns).limit(0)
        df = reduce(DataFrame.unionByName, frames).orderBy(EID).limit(limit)
        return df if columns is None else df.select(SRC, DST, EID, *columns)

    def degrees_from_offsets(self) -> DataFrame:
        """(vid, degree) of the aligned type, from the offset tables alone; a vertex chunk's offsets meet in one task."""
        end = F.lead("offset").over(W.partitionBy("chunk").orderBy(VID))
        n = self.read_vertices_number()
        return self.read_offsets().select(VID, (end - F.col("offset")).alias("degree")).where(F.col("degree").isNotNull() & (F.col(VID) < n))


class GraphReader:
    """Whole graphs as frames by vertex type, and by triplet and layout."""

    @staticmethod
    def read(path: str, spark: SparkSession) -> tuple[dict[str, DataFrame], dict[tuple[str, str, str], dict[str, DataFrame]]]:
        return GraphReader.read_with_graph_info(load_graph_info(spark, path), spark)

    @staticmethod
    def read_with_graph_info(info: GraphInfo, spark: SparkSession):
        vertices = {v.type: VertexReader(info.prefix, v, spark).read_vertex_with_labels() for v in info.vertices}
        edges = {e.triplet: {a.layout.value: EdgeReader(info.prefix, e, a.layout, spark).read_edges() for a in e.adj_lists} for e in info.edges}
        return vertices, edges
