"""Graph, vertex and edge metadata: frozen values, copied on change, read from and written to YAML."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import Store
from .types import AdjListType, Cardinality, FileType, canonical, file_type, spark_type, type_name

VERTEX_CHUNK, EDGE_CHUNK = 1 << 18, 1 << 22  # fixed values: the format's default sizes


@dataclass(frozen=True)
class Version:
    """family/vN (types): the family and number of the format and the user-defined types it declares."""

    family: str = "ql"
    number: int = 1
    user_types: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Version:
        m = re.fullmatch(r"\s*([A-Za-z]+)/v(\d+)\s*(?:\(([^)]*)\))?\s*", text or "")
        if not m:
            raise ValueError(f"no version: {text!r}")
        return cls(m[1], int(m[2]), tuple(x.strip() for x in (m[3] or "").split(",") if x.strip()))

    def __str__(self) -> str:
        return f"{self.family}/v{self.number}" + (f" ({','.join(self.user_types)})" if self.user_types else "")

    def knows(self, type_: str) -> bool:
        """Whether the format, or a declaration, has this type; declared types can't be stored."""
        try:
            canonical(type_)
        except ValueError:
            return type_ in self.user_types
        return True


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    is_primary: bool = False
    is_nullable: bool | None = None
    cardinality: Cardinality = Cardinality.SINGLE

    def __post_init__(self):
        object.__setattr__(self, "type", canonical(self.type))
        object.__setattr__(self, "cardinality", Cardinality(self.cardinality))
        if self.is_nullable is None:
            object.__setattr__(self, "is_nullable", not self.is_primary)
        if self.is_primary and self.is_nullable:
            object.__setattr__(self, "is_nullable", False)

    def spark_type(self) -> T.DataType:
        kind = spark_type(self.type)
        return kind if self.cardinality is Cardinality.SINGLE else T.ArrayType(kind)

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name, "data_type": self.type, "is_primary": self.is_primary}
        if self.is_nullable != (not self.is_primary):
            out["is_nullable"] = self.is_nullable
        if self.cardinality is not Cardinality.SINGLE:
            out["cardinality"] = self.cardinality.value
        return out

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Property:
        return cls(d["name"], d["data_type"], bool(d.get("is_primary", False)), d.get("is_nullable"), Cardinality(d.get("cardinality", "single")))


@dataclass(frozen=True)
class PropertyGroup:
    properties: tuple[Property, ...]
    file_type: FileType = FileType.PARQUET
    prefix: str = ""

    def __post_init__(self):
        object.__setattr__(self, "properties", tuple(self.properties))
        object.__setattr__(self, "file_type", file_type(self.file_type))
        if not self.prefix:
            object.__setattr__(self, "prefix", "_".join(p.name for p in self.properties) + "/")

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.properties]

    def has(self, name: str) -> bool:
        return name in self.names

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"properties": [p.to_dict() for p in self.properties], "file_type": self.file_type.value}
        if self.prefix != "_".join(self.names) + "/":
            out["prefix"] = self.prefix
        return out

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> PropertyGroup:
        return cls(tuple(map(Property.from_dict, d["properties"])), d.get("file_type", "parquet"), d.get("prefix") or "")

    def issues(self, on_edges: bool = False) -> list[str]:
        out = [] if self.properties else ["a property group has no property"]
        for p in self.properties:
            if not p.name:
                out.append("a property has no name")
            if self.file_type is FileType.CSV and (p.type.startswith("list<") or p.cardinality is not Cardinality.SINGLE):
                out.append(f"{p.name}: csv holds no lists")
            if on_edges and p.cardinality is not Cardinality.SINGLE:
                out.append(f"{p.name}: edge properties have single cardinality")
        return out


class _WithGroups:
    """Look-ups and changes that vertex and edge types share."""

    property_groups: tuple[PropertyGroup, ...]

    @property
    def properties(self) -> list[Property]:
        return [p for g in self.property_groups for p in g.properties]

    def has_property(self, name: str) -> bool:
        return any(g.has(name) for g in self.property_groups)

    def get_property(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise KeyError(f"no property {name}")

    def property_group(self, name: str) -> PropertyGroup:
        for g in self.property_groups:
            if g.has(name):
                return g
        raise KeyError(f"no property {name}")

    def property_type(self, name: str) -> str:
        return self.get_property(name).type

    def is_primary(self, name: str) -> bool:
        return self.get_property(name).is_primary

    def is_nullable(self, name: str) -> bool:
        return bool(self.get_property(name).is_nullable)

    def cardinality(self, name: str) -> Cardinality:
        return self.get_property(name).cardinality

    @property
    def primary_key(self) -> str | None:
        return next((p.name for p in self.properties if p.is_primary), None)

    def groups_of(self, columns: Iterable[str] | None) -> list[PropertyGroup]:
        """The groups that hold the columns, so that no other is opened; all, for None."""
        if columns is None:
            return list(self.property_groups)
        wanted = list(columns)
        for c in wanted:
            self.property_group(c)
        return [g for g in self.property_groups if any(g.has(c) for c in wanted)]

    def with_group(self, group: PropertyGroup):
        if any(self.has_property(p.name) for p in group.properties):
            raise ValueError("a property of the group is there already")
        return replace(self, property_groups=(*self.property_groups, group))

    def without_group(self, group: PropertyGroup):
        if group not in self.property_groups:
            raise KeyError("no such group")
        return replace(self, property_groups=tuple(g for g in self.property_groups if g != group))

    def _group_issues(self, on_edges: bool) -> list[str]:
        names = [p.name for p in self.properties]
        out = [x for g in self.property_groups for x in g.issues(on_edges)]
        out += [f"property {n} is there more than once" for n in sorted({n for n in names if names.count(n) > 1})]
        prefixes = [g.prefix for g in self.property_groups]
        return out + [f"prefix {p} is there more than once" for p in sorted({p for p in prefixes if prefixes.count(p) > 1})]


@dataclass(frozen=True)
class VertexInfo(_WithGroups):
    type: str
    chunk_size: int = VERTEX_CHUNK
    property_groups: tuple[PropertyGroup, ...] = ()
    labels: tuple[str, ...] = ()
    prefix: str = ""
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        object.__setattr__(self, "property_groups", tuple(self.property_groups))
        object.__setattr__(self, "labels", tuple(self.labels))
        if not self.prefix:
            object.__setattr__(self, "prefix", f"vertex/{self.type}/")

    def issues(self) -> list[str]:
        out = [] if self.type else ["a vertex type has no name"]
        if self.chunk_size <= 0:
            out.append(f"{self.type}: the chunk size isn't positive")
        if sum(p.is_primary for p in self.properties) > 1:
            out.append(f"{self.type}: more than one primary key")
        return out + self._group_issues(False)

    def is_validated(self) -> bool:
        return not self.issues()

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.type, "chunk_size": self.chunk_size, "prefix": self.prefix}
        if self.labels:
            out["labels"] = list(self.labels)
        return out | {"property_groups": [g.to_dict() for g in self.property_groups], "version": str(self.version)}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> VertexInfo:
        kind = d.get("type", d.get("label"))
        return cls(kind, int(d["chunk_size"]), tuple(map(PropertyGroup.from_dict, d.get("property_groups") or ())), tuple(d.get("labels") or ()), d.get("prefix") or "", Version.parse(d.get("version", "ql/v1")))

    def dump(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)


@dataclass(frozen=True)
class AdjList:
    layout: AdjListType
    file_type: FileType = FileType.PARQUET
    prefix: str = ""

    def __post_init__(self):
        object.__setattr__(self, "layout", AdjListType(self.layout))
        object.__setattr__(self, "file_type", file_type(self.file_type))
        if not self.prefix:
            object.__setattr__(self, "prefix", f"{self.layout.value}/")

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"ordered": self.layout.ordered, "aligned_by": "src" if self.layout.by_source else "dst", "file_type": self.file_type.value}
        return out | ({"prefix": self.prefix} if self.prefix != f"{self.layout.value}/" else {})


@dataclass(frozen=True)
class EdgeInfo(_WithGroups):
    src_type: str
    edge_type: str
    dst_type: str
    chunk_size: int = EDGE_CHUNK
    src_chunk_size: int = VERTEX_CHUNK
    dst_chunk_size: int = VERTEX_CHUNK
    directed: bool = True
    adj_lists: tuple[AdjList, ...] = ()
    property_groups: tuple[PropertyGroup, ...] = ()
    prefix: str = ""
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        object.__setattr__(self, "adj_lists", tuple(self.adj_lists))
        object.__setattr__(self, "property_groups", tuple(self.property_groups))
        if not self.prefix:
            object.__setattr__(self, "prefix", f"edge/{self.name}/")

    @property
    def triplet(self) -> tuple[str, str, str]:
        return self.src_type, self.edge_type, self.dst_type

    @property
    def name(self) -> str:
        return "_".join(self.triplet)

    def has_layout(self, layout: AdjListType) -> bool:
        return any(a.layout is AdjListType(layout) for a in self.adj_lists)

    def adj_list(self, layout: AdjListType) -> AdjList:
        for a in self.adj_lists:
            if a.layout is AdjListType(layout):
                return a
        raise KeyError(f"{self.name} has no layout {AdjListType(layout).value}")

    def aligned_chunk(self, layout: AdjListType) -> int:
        return self.src_chunk_size if AdjListType(layout).by_source else self.dst_chunk_size

    def with_adj_list(self, a: AdjList) -> EdgeInfo:
        if self.has_layout(a.layout):
            raise ValueError("the layout is there already")
        return replace(self, adj_lists=(*self.adj_lists, a))

    def without_adj_list(self, layout: AdjListType) -> EdgeInfo:
        gone = self.adj_list(layout)
        return replace(self, adj_lists=tuple(a for a in self.adj_lists if a != gone))

    def issues(self) -> list[str]:
        out = [] if all(self.triplet) else ["an edge type lacks a name"]
        if min(self.chunk_size, self.src_chunk_size, self.dst_chunk_size) <= 0:
            out.append(f"{self.name}: a chunk size isn't positive")
        layouts = [a.layout for a in self.adj_lists]
        if not layouts:
            out.append(f"{self.name}: no layout")
        if len(set(layouts)) < len(layouts):
            out.append(f"{self.name}: a layout is there more than once")
        return out + self._group_issues(True)

    def is_validated(self) -> bool:
        return not self.issues()

    def to_dict(self) -> dict[str, Any]:
        return {
            "src_type": self.src_type, "edge_type": self.edge_type, "dst_type": self.dst_type, "chunk_size": self.chunk_size, "src_chunk_size": self.src_chunk_size,
            "dst_chunk_size": self.dst_chunk_size, "directed": self.directed, "prefix": self.prefix, "adj_lists": [a.to_dict() for a in self.adj_lists],
            "property_groups": [g.to_dict() for g in self.property_groups], "version": str(self.version),
        }

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> EdgeInfo:
        names = [d.get(f"{k}_type", d.get(f"{k}_label")) for k in ("src", "edge", "dst")]
        lists = [AdjList(AdjListType.of(bool(a.get("ordered")), a.get("aligned_by", "src")), a.get("file_type", "parquet"), a.get("prefix") or "") for a in d.get("adj_lists") or ()]
        sizes = [int(d[k]) for k in ("chunk_size", "src_chunk_size", "dst_chunk_size")]
        return cls(*names, *sizes, bool(d.get("directed", True)), tuple(lists), tuple(map(PropertyGroup.from_dict, d.get("property_groups") or ())), d.get("prefix") or "", Version.parse(d.get("version", "ql/v1")))

    def dump(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)


@dataclass(frozen=True)
class GraphInfo:
    name: str
    vertices: tuple[VertexInfo, ...] = ()
    edges: tuple[EdgeInfo, ...] = ()
    prefix: str = "./"
    labels: tuple[str, ...] = ()
    extra: tuple[tuple[str, str], ...] = ()
    version: Version = field(default_factory=Version)

    def __post_init__(self):
        for k in ("vertices", "edges", "labels", "extra"):
            object.__setattr__(self, k, tuple(getattr(self, k)))

    def has_vertex(self, type_: str) -> bool:
        return any(v.type == type_ for v in self.vertices)

    def vertex(self, type_: str) -> VertexInfo:
        for v in self.vertices:
            if v.type == type_:
                return v
        raise KeyError(f"no vertex type {type_}")

    def has_edge(self, src: str, edge: str, dst: str) -> bool:
        return any(e.triplet == (src, edge, dst) for e in self.edges)

    def edge(self, src: str, edge: str, dst: str) -> EdgeInfo:
        for e in self.edges:
            if e.triplet == (src, edge, dst):
                return e
        raise KeyError(f"no edge type {src}, {edge}, {dst}")

    def with_vertex(self, v: VertexInfo) -> GraphInfo:
        if self.has_vertex(v.type):
            raise ValueError(f"vertex type {v.type} is there already")
        return replace(self, vertices=(*self.vertices, v))

    def with_edge(self, e: EdgeInfo) -> GraphInfo:
        if self.has_edge(*e.triplet):
            raise ValueError(f"edge type {e.name} is there already")
        return replace(self, edges=(*self.edges, e))

    def without_vertex(self, type_: str) -> GraphInfo:
        gone = self.vertex(type_)
        return replace(self, vertices=tuple(v for v in self.vertices if v != gone))

    def without_edge(self, src: str, edge: str, dst: str) -> GraphInfo:
        gone = self.edge(src, edge, dst)
        return replace(self, edges=tuple(e for e in self.edges if e != gone))

    def issues(self) -> list[str]:
        out = [] if self.name else ["the graph has no name"]
        out += [x for t in (*self.vertices, *self.edges) for x in t.issues()]
        for names, what in (([v.type for v in self.vertices], "vertex type"), ([e.name for e in self.edges], "edge type")):
            out += [f"{what} {n} is there more than once" for n in sorted({n for n in names if names.count(n) > 1})]
        for e in self.edges:
            for end, size in ((e.src_type, e.src_chunk_size), (e.dst_type, e.dst_chunk_size)):
                if not self.has_vertex(end):
                    out.append(f"{e.name}: no vertex type {end}")
                elif self.vertex(end).chunk_size != size:
                    out.append(f"{e.name}: its chunk size for {end} isn't that of the vertex type")
        return out

    def is_validated(self) -> bool:
        return not self.issues()

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name, "prefix": self.prefix, "vertices": [f"{v.type}.vertex.yml" for v in self.vertices], "edges": [f"{e.name}.edge.yml" for e in self.edges]}
        if self.labels:
            out["labels"] = list(self.labels)
        if self.extra:
            out["extra_info"] = [{"key": k, "value": v} for k, v in self.extra]
        return out | {"version": str(self.version)}

    def dump(self) -> str:
        return yaml.safe_dump(self.to_dict(), sort_keys=False, allow_unicode=True)

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write all metadata files into a folder, the graph's last; returns its path."""
        store, folder = Store(spark), folder.rstrip("/")
        for v in self.vertices:
            store.write_text(f"{folder}/{v.type}.vertex.yml", v.dump())
        for e in self.edges:
            store.write_text(f"{folder}/{e.name}.edge.yml", e.dump())
        store.write_text(path := f"{folder}/{self.name}.graph.yml", self.dump())
        return path


def load_vertex_info(spark: SparkSession, path: str) -> VertexInfo:
    return VertexInfo.from_dict(yaml.safe_load(Store(spark).read_text(path)))


def load_edge_info(spark: SparkSession, path: str) -> EdgeInfo:
    return EdgeInfo.from_dict(yaml.safe_load(Store(spark).read_text(path)))


def load_graph_info(spark: SparkSession, path: str) -> GraphInfo:
    """The graph's metadata; its prefix, if none or relative, is resolved against the folder of the file."""
    d = yaml.safe_load(Store(spark).read_text(path))
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else "./"
    prefix = d.get("prefix") or ""
    if not re.match(r"/|\w+://|\w+:/", prefix):
        prefix = folder + prefix.removeprefix("./")
    extra = [(x["key"], x["value"]) for x in d["extra_info"]] if isinstance(d.get("extra_info"), list) else list((d.get("extra_info") or {}).items())
    return GraphInfo(
        d["name"], [load_vertex_info(spark, folder + v) for v in d.get("vertices") or ()], [load_edge_info(spark, folder + e) for e in d.get("edges") or ()],
        prefix if prefix.endswith("/") else prefix + "/", d.get("labels") or (), extra, Version.parse(d.get("version", "ql/v1")),
    )


def infer_properties(df: DataFrame, skip: Iterable[str] = (), primary: str | None = None) -> tuple[Property, ...]:
    """A property for each column of a frame."""
    gone = set(skip)
    return tuple(Property(f.name, type_name(f.dataType), f.name == primary, None) for f in df.schema.fields if f.name not in gone)


def infer_graph_info(
    name: str, vertices: dict[str, tuple[DataFrame, str]], edges: dict[tuple[str, str, str], DataFrame],
    vertex_chunk: int = VERTEX_CHUNK, edge_chunk: int = EDGE_CHUNK, kind: str = "parquet", version: str = "ql/v1",
) -> GraphInfo:
    """Metadata for frames: one group a type, CSR and CSC layouts. The first two columns of edges are their ends."""
    v = [VertexInfo(t, vertex_chunk, (PropertyGroup(infer_properties(df.drop(":LABEL"), (), pk), kind),), (), "", Version.parse(version)) for t, (df, pk) in vertices.items()]
    e = []
    for t, df in edges.items():
        rest = infer_properties(df, df.columns[:2])
        lists = (AdjList(AdjListType.ORDERED_BY_SOURCE, kind), AdjList(AdjListType.ORDERED_BY_DEST, kind))
        e.append(EdgeInfo(*t, edge_chunk, vertex_chunk, vertex_chunk, True, lists, (PropertyGroup(rest, kind),) if rest else (), "", Version.parse(version)))
    return GraphInfo(name, v, e, "./", (), (), Version.parse(version))
