"""Exports to other systems, such as graph databases, by any of Spark's connectors: ends of edges go by their primary keys, not by ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.access import with_primary_keys
from ..plans.types import VID


def export(df: DataFrame, format: str, options: dict[str, str] | None = None, path: str = "", mode: str = "append", tasks: int | None = None) -> None:
    """Write with a connector. tasks: the most writers at once, for systems that lock what they write (both ends of an edge, say)."""
    writer = (df if tasks is None else df.coalesce(tasks)).write.format(format).options(**(options or {})).mode(mode)
    writer.save(path) if path else writer.save()


def export_vertices(v: DataFrame, format: str, options: dict[str, str] | None = None, **how) -> None:
    """Vertices without their ids, which are this archive's own."""
    export(v.drop(VID), format, options, **how)


def export_edges(e: DataFrame, src_map: DataFrame, dst_map: DataFrame, format: str, options: dict[str, str] | None = None, **how) -> None:
    """Edges with src_key and dst_key in front; maps are (key, vid)."""
    export(with_primary_keys(e, src_map, dst_map), format, options, **how)
