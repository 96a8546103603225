"""Graph-to-graph transformation: other file types, chunk sizes, property groups or layouts, with the same ids."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.info import EdgeInfo, GraphInfo, load_graph_info
from ..plans.types import DST, LABELS, SRC, VID, AdjListType
from ..sinks.writers import EdgeWriter, VertexWriter
from ..sources.readers import EdgeReader, VertexReader


def source_layout(source: EdgeInfo, wanted: AdjListType) -> AdjListType:
    """The same layout if the source has it, otherwise its first."""
    return wanted if source.has_layout(wanted) else source.adj_lists[0].layout


class GraphTransformer:
    @staticmethod
    def transform(source_path: str, dest_path: str, spark: SparkSession) -> None:
        """From one metadata file to another; the data goes to the prefix of the second."""
        GraphTransformer.transform_info(load_graph_info(spark, source_path), load_graph_info(spark, dest_path), spark)

    @staticmethod
    def transform_info(source: GraphInfo, dest: GraphInfo, spark: SparkSession) -> None:
        if bad := dest.issues():
            raise ValueError("; ".join(bad))
        counts = {}
        for v in dest.vertices:  # a type that the source lacks is an error before anything is written
            source.vertex(v.type)
        for e in dest.edges:
            source.edge(*e.triplet)
        for v in dest.vertices:
            reader = VertexReader(source.prefix, source.vertex(v.type), spark)
            counts[v.type] = reader.read_vertices_number()
            df = reader.read_all_vertex_property_groups([p.name for p in v.properties])
            if v.labels:
                if missing := set(v.labels) - set(reader.info.labels):
                    raise KeyError(f"the source lacks the labels {sorted(missing)}")
                df = df.join(reader.read_vertex_labels(), VID, "left")
            VertexWriter(dest.prefix, v, df.select(VID, *[p.name for p in v.properties], *([F.col(f"`{LABELS}`")] if v.labels else [])), counts[v.type]).write()
        for e in dest.edges:
            own = source.edge(*e.triplet)
            for a in e.adj_lists:
                reader = EdgeReader(source.prefix, own, source_layout(own, a.layout), spark)
                df = reader.read_edges(False, [p.name for p in e.properties]).select(SRC, DST, *[p.name for p in e.properties])
                end = e.src_type if a.layout.by_source else e.dst_type
                n = counts.get(end)
                if n is None:
                    n = VertexReader(source.prefix, source.vertex(end), spark).read_vertices_number()
                EdgeWriter(dest.prefix, e, a.layout, n, df).write_edges()


def convert_layout(prefix: str, info: EdgeInfo, source: AdjListType | str, wanted: AdjListType | str, dest_prefix: str, dest: EdgeInfo, count: int, spark: SparkSession) -> None:
    """One layout of one edge type made from another, say unordered to CSR; count: of the wanted layout's aligned type."""
    df = EdgeReader(prefix, info, source, spark).read_edges(False)
    EdgeWriter(dest_prefix, dest, wanted, count, df).write_edges()
