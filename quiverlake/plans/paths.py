"""Where an archive keeps what: pure functions of metadata."""

from __future__ import annotations

from .info import EdgeInfo, PropertyGroup, VertexInfo
from .types import AdjListType


def chunk_count(rows: int, size: int) -> int:
    return -(-rows // size)


def vertex_count(prefix: str, v: VertexInfo) -> str:
    return f"{prefix}{v.prefix}vertex_count"


def vertex_group(prefix: str, v: VertexInfo, g: PropertyGroup) -> str:
    return f"{prefix}{v.prefix}{g.prefix}"


def vertex_chunk(prefix: str, v: VertexInfo, g: PropertyGroup, chunk: int) -> str:
    return f"{vertex_group(prefix, v, g)}chunk{chunk}"


def label_folder(prefix: str, v: VertexInfo) -> str:
    return f"{prefix}{v.prefix}labels/"


def label_chunk(prefix: str, v: VertexInfo, chunk: int) -> str:
    return f"{label_folder(prefix, v)}chunk{chunk}"


def layout_folder(prefix: str, e: EdgeInfo, layout: AdjListType) -> str:
    return f"{prefix}{e.prefix}{e.adj_list(layout).prefix}"


def edge_vertex_count(prefix: str, e: EdgeInfo, layout: AdjListType) -> str:
    return f"{layout_folder(prefix, e, layout)}vertex_count"


def edge_count(prefix: str, e: EdgeInfo, layout: AdjListType, part: int) -> str:
    return f"{layout_folder(prefix, e, layout)}edge_count{part}"


def adj_folder(prefix: str, e: EdgeInfo, layout: AdjListType) -> str:
    return f"{layout_folder(prefix, e, layout)}adj_list/"


def adj_part(prefix: str, e: EdgeInfo, layout: AdjListType, part: int) -> str:
    return f"{adj_folder(prefix, e, layout)}part{part}/"


def adj_chunk(prefix: str, e: EdgeInfo, layout: AdjListType, part: int, chunk: int) -> str:
    return f"{adj_part(prefix, e, layout, part)}chunk{chunk}"


def offset_folder(prefix: str, e: EdgeInfo, layout: AdjListType) -> str:
    return f"{layout_folder(prefix, e, layout)}offset/"


def offset_chunk(prefix: str, e: EdgeInfo, layout: AdjListType, part: int) -> str:
    return f"{offset_folder(prefix, e, layout)}chunk{part}"


def edge_group(prefix: str, e: EdgeInfo, layout: AdjListType, g: PropertyGroup) -> str:
    return f"{layout_folder(prefix, e, layout)}{g.prefix}"


def edge_group_part(prefix: str, e: EdgeInfo, layout: AdjListType, g: PropertyGroup, part: int) -> str:
    return f"{edge_group(prefix, e, layout, g)}part{part}/"


def edge_group_chunk(prefix: str, e: EdgeInfo, layout: AdjListType, g: PropertyGroup, part: int, chunk: int) -> str:
    return f"{edge_group_part(prefix, e, layout, g, part)}chunk{chunk}"
