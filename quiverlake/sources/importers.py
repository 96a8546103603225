"""Imports: files of several formats to typed frames to a stored graph, by a config.

A source is a file with its columns' new names; several sources of a type are put together by row identity of their
columns (bag union). External databases are sources with a `format` and `options` of the connector (a graph database's, say: which labels,
or a query in its language), or ready frames through `frames`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.info import AdjList, EdgeInfo, GraphInfo, Property, PropertyGroup, Version, VertexInfo
from ..plans.types import AdjListType, FileType
from ..session import Store
from ..sinks.writers import GraphWriter, ValidateLevel

# The config's defaults.
DEFAULTS = {"vertex_chunk_size": 100, "edge_chunk_size": 1024, "file_type": "parquet", "adj_list_type": "ordered_by_source", "validate_level": "weak"}


@dataclass(frozen=True)
class Source:
    path: str
    columns: dict[str, str]
    file_type: str = ""
    delimiter: str = ","
    format: str = ""  # a connector's name; then path may be empty and file_type isn't used
    options: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.path or self.format

    def kind(self) -> FileType:
        name = self.file_type or (self.path.rsplit(".", 1)[1] if "." in self.path.rsplit("/", 1)[-1] else "")
        try:
            return FileType(name.lower())
        except ValueError:
            raise ValueError(f"{self.path}: no known file type {name!r}") from None

    def issues(self) -> list[str]:
        out = []
        if len(self.delimiter) != 1:
            out.append(f"{self.name}: the delimiter isn't one character")
        if len(set(self.columns.values())) < len(self.columns):
            out.append(f"{self.name}: two columns get one name")
        if not self.format:
            try:
                self.kind()
            except ValueError as e:
                out.append(str(e))
        return out


def read_source(spark: SparkSession, source: Source, types: dict[str, Property] | None = None) -> DataFrame:
    """The source's named columns, renamed and cast to the properties' types. JSON is one object a line."""
    if source.format:
        reader = spark.read.format(source.format)
    else:
        kind = source.kind()
        reader = spark.read.format(kind.value)
        if kind is FileType.CSV:
            reader = reader.option("header", "true").option("sep", source.delimiter)
    reader = reader.options(**source.options)
    df = reader.load(source.path) if source.path else reader.load()
    if lost := [c for c in source.columns if c not in df.columns]:
        raise ValueError(f"{source.name} lacks the columns {lost}")
    out = []
    for old, new in source.columns.items():
        c = F.col(f"`{old}`")
        if types and new in types:
            c = c.cast(types[new].spark_type())
        out.append(c.alias(new))
    return df.select(*out)


def merge_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_edge_list(spark: SparkSession, path: str, sep: str = r"\s+", comment: str = "#") -> DataFrame:
    """(src, dst) of a text of two numbers a line, as public network collections have them; comment lines are skipped."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), sep)
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


@dataclass
class ImportConfig:
    path: str
    name: str
    settings: dict[str, Any] = field(default_factory=dict)
    vertices: list[dict[str, Any]] = field(default_factory=list)
    edges: list[dict[str, Any]] = field(default_factory=list)
    top: str = ""

    @classmethod
    def parse(cls, text: str) -> ImportConfig:
        """A YAML text: one section of settings with path and name, and import_schema with vertices and edges."""
        d = yaml.safe_load(text)
        sections = [k for k in d if k != "import_schema"]
        if len(sections) != 1 or "import_schema" not in d:
            raise ValueError("a config has one section of settings, and import_schema")
        s = dict(d[sections[0]])
        schema = d["import_schema"]
        return cls(s.pop("path"), s.pop("name"), s, schema.get("vertices") or [], schema.get("edges") or [], sections[0])

    def setting(self, own: dict[str, Any], key: str, top: str | None = None) -> Any:
        """An explicit value of a type goes before the settings', and these before the default."""
        value = own.get(key)
        if value is None:
            value = self.settings.get(top or key)
        return DEFAULTS.get(top or key) if value is None else value

    def _groups(self, own: dict[str, Any]) -> tuple[PropertyGroup, ...]:
        out = []
        for g in own.get("property_groups") or ():
            props = tuple(Property(p["name"], p["data_type"], bool(p.get("is_primary")), p.get("nullable")) for p in g["properties"])
            out.append(PropertyGroup(props, g.get("file_type") or self.setting({}, "file_type")))
        return tuple(out)

    def graph_info(self) -> GraphInfo:
        version = Version.parse(self.settings.get("version") or "ql/v1")
        v = [VertexInfo(x["type"], int(self.setting(x, "chunk_size", "vertex_chunk_size")), self._groups(x), tuple(x.get("labels") or ()), x.get("prefix") or "", version) for x in self.vertices]
        sizes = {x.type: x.chunk_size for x in v}
        e = []
        for x in self.edges:
            layouts = x.get("adj_lists") or [{}]
            lists = []
            for a in layouts:
                layout = AdjListType.of(bool(a.get("ordered")), a["aligned_by"]) if "aligned_by" in a else AdjListType(self.setting({}, "adj_list_type"))
                lists.append(AdjList(layout, a.get("file_type") or self.setting({}, "file_type")))
            default = int(self.setting({}, "vertex_chunk_size"))
            e.append(EdgeInfo(x["src_type"], x["edge_type"], x["dst_type"], int(self.setting(x, "chunk_size", "edge_chunk_size")), sizes.get(x["src_type"], default), sizes.get(x["dst_type"], default), bool(x.get("directed", True)), tuple(lists), self._groups(x), x.get("prefix") or "", version))
        return GraphInfo(self.name, v, e, self.path.rstrip("/") + "/", (), (), version)

    @staticmethod
    def _sources(own: dict[str, Any]) -> list[Source]:
        return [
            Source(
                s["path"] if "format" not in s else s.get("path") or "",
                dict(s["columns"]),
                s.get("file_type") or "",
                s.get("delimiter") or ",",
                s.get("format") or "",
                {k: str(x) for k, x in (s.get("options") or {}).items()},
            )
            for s in own.get("sources") or ()
        ]

    def issues(self) -> list[str]:
        """Duplicates, keys, columns that aren't covered, unknown ends, beside the metadata's own rules."""
        try:
            info = self.graph_info()
        except (KeyError, ValueError) as e:
            return [str(e)]
        out = info.issues()
        for own, v in zip(self.vertices, info.vertices, strict=True):
            if sum(p.is_primary for p in v.properties) != 1:
                out.append(f"{v.type}: not exactly one primary key")
            if not self._sources(own):
                out.append(f"{v.type}: no source")
            for s in self._sources(own):
                out += s.issues()
                if lost := {p.name for p in v.properties} - set(s.columns.values()):
                    out.append(f"{v.type}: {s.name} doesn't give {sorted(lost)}")
        for own, e in zip(self.edges, info.edges, strict=True):
            ends = [own.get("src_prop"), own.get("dst_prop")]
            for end, prop in zip((e.src_type, e.dst_type), ends, strict=True):
                if info.has_vertex(end) and not info.vertex(end).has_property(prop or ""):
                    out.append(f"{e.name}: {end} has no property {prop}")
            if any(p.is_primary for p in e.properties):
                out.append(f"{e.name}: edges have no primary key")
            if not self._sources(own):
                out.append(f"{e.name}: no source")
        return out


def run_import(spark: SparkSession, config: ImportConfig | str, frames: dict[str, DataFrame] | None = None, save: bool = True) -> GraphInfo:
    """Read, check and write. Edge sources name their ends' columns `src` and `dst` in `columns`, or after src_prop and dst_prop.

    An edge whose end is unknown is an error. frames: ready frames by vertex type or edge name, in place of sources.
    """
    config = ImportConfig.parse(Store(spark).read_text(config)) if isinstance(config, str) else config
    frames = frames or {}
    if bad := [x for x in config.issues() if not any(f"{k}: no source" in x for k in frames)]:
        raise ValueError("; ".join(bad))
    info = config.graph_info()
    writer = GraphWriter()
    for own, v in zip(config.vertices, info.vertices, strict=True):
        types = {p.name: p for p in v.properties}
        df = frames.get(v.type)
        df = merge_sources([read_source(spark, s, types) for s in config._sources(own)]) if df is None else df
        writer.put_vertex_data(v.type, df, v.primary_key)
    for own, e in zip(config.edges, info.edges, strict=True):
        types = {p.name: p for p in e.properties}
        df = frames.get(e.name)
        df = merge_sources([read_source(spark, s, types) for s in config._sources(own)]) if df is None else df
        s, d = (("src", "dst") if {"src", "dst"} <= set(df.columns) else (own["src_prop"], own["dst_prop"]))
        for end, column, prop in ((e.src_type, s, own["src_prop"]), (e.dst_type, d, own["dst_prop"])):
            df = df.withColumn(column, F.col(f"`{column}`").cast(info.vertex(end).get_property(prop).spark_type()))
            if prop != info.vertex(end).primary_key:
                raise ValueError(f"{e.name}: {prop} isn't the primary key of {end}")
        writer.put_edge_data(e.triplet, df.select(s, d, *types))
    level = ValidateLevel(config.setting({}, "validate_level"))
    return writer.write_with_graph_info(spark, info, config.path, level, strict=True, save=save)
