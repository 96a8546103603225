"""Validation of a stored archive: files, counts, schemas, id bounds, alignment, order, offsets.

Small files are read on the driver; rows are checked by one aggregate a property group, layout and check, grouped by chunk, so what comes back grows with the number of chunks alone.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..plans import paths
from ..plans.info import EdgeInfo, GraphInfo, PropertyGroup, VertexInfo
from ..plans.types import FileType, Reserved
from ..session import Store
from ..sources.readers import read_files

# The codes of issues.
CODES = (
    "VERTEX_COUNT_MISMATCH", "VERTEX_COUNT_UNAVAILABLE", "EDGE_VERTEX_COUNT_MISMATCH", "TOPOLOGY_ROW_COUNT", "UNORDERED_OFFSET", "OFFSET_ALIGNMENT_UNKNOWN", "OFFSET_ROW_COUNT",
    "CHUNK_ROW_COUNT", "SCHEMA_MISMATCH", "READ_FAILURE", "CONTROL_SIZE", "CONTROL_NEGATIVE", "CONTROL_READ", "MISSING_FILE", "STORAGE_FAILURE", "TOPOLOGY_TYPE", "NEGATIVE_ID",
    "SOURCE_ID_BOUNDS", "DESTINATION_ID_BOUNDS", "PARTITION_ALIGNMENT", "ORDEREDNESS", "VERTEX_INDEX_TYPE", "VERTEX_INDEX_SEQUENCE", "OFFSET_TYPE", "OFFSET_MONOTONICITY", "OFFSET_TERMINAL",
)


@dataclass(frozen=True)
class Issue:
    code: str
    path: str
    message: str


class DatasetValidator:
    """strict: an offset chunk of the last vertices may not be padded to a full chunk."""

    def __init__(self, spark: SparkSession, info: GraphInfo, strict: bool = False):
        self.spark, self.info, self.strict = spark, info, strict
        self.store = Store(spark)
        self.issues: list[Issue] = []

    def _say(self, code: str, path: str, message: str) -> None:
        assert code in CODES
        self.issues.append(Issue(code, path, message))

    def validate(self) -> list[Issue]:
        self.issues = []
        counts = {v.type: self._vertex(v) for v in self.info.vertices}
        for e in self.info.edges:
            for a in e.adj_lists:
                self._edge(e, a.layout, counts)
        return self.issues

    def report(self) -> DataFrame:
        rows = [(i.code, i.path, i.message) for i in self.validate()]
        return self.spark.createDataFrame(rows, "code string, path string, message string")

    def require_valid(self) -> None:
        if self.validate():
            raise ValueError("; ".join(f"{i.code} {i.path}: {i.message}" for i in self.issues))

    # files

    def _control(self, path: str) -> int | None:
        try:
            if not self.store.exists(path):
                self._say("MISSING_FILE", path, "a control file is missing")
                return None
            data = self.store.read_bytes(path)
        except Exception as e:  # the store's own errors, whatever store it is
            self._say("CONTROL_READ", path, str(e)[:200])
            return None
        if len(data) != 8:
            self._say("CONTROL_SIZE", path, f"{len(data)} bytes instead of 8")
            return None
        n = struct.unpack("<q", data)[0]
        if n < 0:
            self._say("CONTROL_NEGATIVE", path, f"count {n}")
            return None
        return n

    def _there(self, files: list[str]) -> bool:
        """Whether all files are there; the folders are listed, not each file asked for."""
        listed: dict[str, set[str]] = {}
        ok = True
        for f in files:
            folder, name = f.rsplit("/", 1)
            if folder not in listed:
                try:
                    listed[folder] = {p.rsplit("/", 1)[1] for p, is_dir, _ in self.store.list(folder) if not is_dir}
                except Exception as e:
                    self._say("STORAGE_FAILURE", folder, str(e)[:200])
                    listed[folder] = set()
            if name not in listed[folder]:
                self._say("MISSING_FILE", f, "a file that the metadata names is missing")
                ok = False
        return ok

    def _frame(self, kind: FileType, files: list[str]) -> DataFrame | None:
        """Rows with __file (and __row for Parquet), or None if they can't be read."""
        try:
            df = read_files(self.spark, kind, files)
            extra = [F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("__file"), F.regexp_extract(F.col("_metadata.file_path"), r"part(\d+)/chunk\d+$", 1).alias("__part")]
            extra.append(F.regexp_extract(F.col("_metadata.file_path"), r"chunk(\d+)$", 1).cast("long").alias("__chunk"))
            if kind is FileType.PARQUET:
                extra.append(F.col("_metadata.row_index").alias("__row"))
            df = df.select("*", *extra)
            df.limit(1).collect()
            return df
        except Exception as e:
            self._say("READ_FAILURE", files[0], str(e).splitlines()[0][:200])
            return None

    def _schema(self, df: DataFrame, g: PropertyGroup, path: str) -> bool:
        if g.file_type in (FileType.CSV, FileType.JSON):
            lost = [p.name for p in g.properties if p.name not in df.columns]
        else:
            have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            lost = [p.name for p in g.properties if have.get(p.name) not in (p.spark_type().simpleString(), p.spark_type().simpleString() + "_ntz")]
        if lost:
            self._say("SCHEMA_MISMATCH", path, f"columns {lost} are missing or of another type")
        return not lost

    # vertices

    def _vertex(self, v: VertexInfo) -> int | None:
        n = self._control(where := paths.vertex_count(self.info.prefix, v))
        if n is None:
            self._say("VERTEX_COUNT_UNAVAILABLE", where, f"chunks of {v.type} can't be checked")
            return None
        chunks = paths.chunk_count(n, v.chunk_size)
        for g in v.property_groups:
            files = [paths.vertex_chunk(self.info.prefix, v, g, c) for c in range(chunks)]
            if not files or not self._there(files):
                continue
            df = self._frame(g.file_type, files)
            if df is None or not self._schema(df, g, paths.vertex_group(self.info.prefix, v, g)):
                continue
            name = Reserved.found(df.columns, "VertexIndex")[0]
            if g.file_type is FileType.PARQUET and not isinstance(df.schema[name].dataType, T.LongType):
                self._say("VERTEX_INDEX_TYPE", files[0], "vertex ids aren't INT64")
                continue
            vid = F.col(name).cast("long")
            tests = [F.count("*").alias("n"), F.min(vid).alias("lo"), F.max(vid).alias("hi"), F.count_distinct(vid).alias("d")]
            if "__row" in df.columns:
                tests.append(F.count_if(vid != F.col("__chunk") * v.chunk_size + F.col("__row")).alias("off"))
            seen = 0
            for r in df.groupBy("__chunk").agg(*tests).collect():
                first = r["__chunk"] * v.chunk_size
                want = min(v.chunk_size, n - first)
                path, seen = files[r["__chunk"]], seen + r.n
                if r.n != want:
                    self._say("CHUNK_ROW_COUNT", path, f"{r.n} rows instead of {want}")
                if (r.lo, r.hi - r.lo + 1, r.d) != (first, r.n, r.n) or ("off" in r and r.off):
                    self._say("VERTEX_INDEX_SEQUENCE", path, "ids don't count up from the chunk's first")
            if seen != n:
                self._say("VERTEX_COUNT_MISMATCH", where, f"{seen} rows in a group, the count is {n}")
        if v.labels:
            files = [paths.label_chunk(self.info.prefix, v, c) for c in range(chunks)]
            if files and self._there(files) and (df := self._frame(FileType.PARQUET, files)) is not None:
                bad = [x for x in v.labels if x not in df.columns or not isinstance(df.schema[x].dataType, T.BooleanType)]
                if bad:
                    self._say("SCHEMA_MISMATCH", paths.label_folder(self.info.prefix, v), f"labels {bad} have no Boolean column")
                if (rows := df.count()) != n:
                    self._say("CHUNK_ROW_COUNT", paths.label_folder(self.info.prefix, v), f"{rows} rows of labels instead of {n}")
        return n

    # edges

    def _edge(self, e: EdgeInfo, layout, counts: dict[str, int | None]) -> None:
        prefix, adj = self.info.prefix, e.adj_list(layout)
        end = e.src_type if layout.by_source else e.dst_type
        n = self._control(where := paths.edge_vertex_count(prefix, e, layout))
        known = counts.get(end)
        if n is not None and known is not None and n != known:
            self._say("EDGE_VERTEX_COUNT_MISMATCH", where, f"{n}, but {end} has {known} vertices")
        if n is None:
            self._say("OFFSET_ALIGNMENT_UNKNOWN", where, "vertex chunks can't be told")
            return
        size = e.aligned_chunk(layout)
        per = [self._control(paths.edge_count(prefix, e, layout, p)) for p in range(paths.chunk_count(n, size))]
        pieces = {p: paths.chunk_count(c, e.chunk_size) for p, c in enumerate(per) if c}
        files = [paths.adj_chunk(prefix, e, layout, p, c) for p, k in pieces.items() for c in range(k)]
        if files and self._there(files):
            self._topology(e, layout, files, per, counts)
        for g in e.property_groups:
            own = [paths.edge_group_chunk(prefix, e, layout, g, p, c) for p, k in pieces.items() for c in range(k)]
            if own and self._there(own) and (df := self._frame(g.file_type, own)) is not None and self._schema(df, g, paths.edge_group(prefix, e, layout, g)):
                self._rows(df, e, per, lambda p, c, g=g: paths.edge_group_chunk(prefix, e, layout, g, p, c), "CHUNK_ROW_COUNT")
        offsets = paths.offset_folder(prefix, e, layout)
        if not layout.ordered:
            if self.store.exists(offsets):
                self._say("UNORDERED_OFFSET", offsets, "an unordered layout has offsets")
            return
        own = [paths.offset_chunk(prefix, e, layout, p) for p in range(len(per))]
        if own and self._there(own):
            self._offsets(e, adj.file_type, own, per, n, size)

    def _rows(self, df: DataFrame, e: EdgeInfo, per: list[int | None], name_of, code: str) -> None:
        for r in df.groupBy(F.col("__part").cast("long").alias("p"), "__chunk").agg(F.count("*").alias("n")).collect():
            want = min(e.chunk_size, (per[r.p] or 0) - r["__chunk"] * e.chunk_size)
            if r.n != want:
                self._say(code, name_of(r.p, r["__chunk"]), f"{r.n} rows instead of {want}")

    def _topology(self, e: EdgeInfo, layout, files: list[str], per: list[int | None], counts: dict[str, int | None]) -> None:
        prefix, adj = self.info.prefix, e.adj_list(layout)
        df = self._frame(adj.file_type, files)
        if df is None:
            return
        src, dst = Reserved.found(df.columns, "SrcIndex", "DstIndex")
        if adj.file_type in (FileType.PARQUET, FileType.ORC) and any(not isinstance(df.schema[c].dataType, T.LongType) for c in (src, dst)):
            self._say("TOPOLOGY_TYPE", files[0], "ends aren't INT64")
            return
        self._rows(df, e, per, lambda p, c: paths.adj_chunk(prefix, e, layout, p, c), "TOPOLOGY_ROW_COUNT")
        s, d = F.col(src).cast("long"), F.col(dst).cast("long")
        aligned, size = (s, e.src_chunk_size) if layout.by_source else (d, e.dst_chunk_size)
        part = F.col("__part").cast("long")
        tests = [F.count_if((s < 0) | (d < 0)).alias("NEGATIVE_ID"), F.count_if(F.floor(aligned / size) != part).alias("PARTITION_ALIGNMENT")]
        for code, c, kind in (("SOURCE_ID_BOUNDS", s, e.src_type), ("DESTINATION_ID_BOUNDS", d, e.dst_type)):
            if counts.get(kind) is not None:
                tests.append(F.count_if(c >= counts[kind]).alias(code))
        for r in df.groupBy(part.alias("p")).agg(*tests).collect():
            for code, n in r.asDict().items():
                if code != "p" and n:
                    self._say(code, paths.adj_part(prefix, e, layout, r.p), f"{n} edges")
        if layout.ordered and "__row" in df.columns:
            before = F.lag(aligned).over(W.partitionBy("__part").orderBy("__chunk", "__row"))
            wrong = df.select(part.alias("p"), (before > aligned).alias("bad")).where("bad").groupBy("p").count().collect()
            for r in wrong:
                self._say("ORDEREDNESS", paths.adj_part(prefix, e, layout, r.p), f"{r['count']} edges stand before a smaller one")

    def _offsets(self, e: EdgeInfo, kind: FileType, files: list[str], per: list[int | None], n: int, size: int) -> None:
        df = self._frame(kind, files)
        if df is None:
            return
        name = Reserved.found(df.columns, "Offset")[0]
        if kind in (FileType.PARQUET, FileType.ORC) and not isinstance(df.schema[name].dataType, T.LongType):
            self._say("OFFSET_TYPE", files[0], "offsets aren't INT64")
        o = F.col(name).cast("long")
        tests = [F.count("*").alias("n"), F.min(o).alias("lo"), F.max(o).alias("hi")]
        if "__row" in df.columns:
            down = F.lag(o).over(W.partitionBy("__chunk").orderBy("__row")) > o
            df = df.withColumn("__down", down)
            tests += [F.count_if("__down").alias("down"), F.min_by(o, "__row").alias("first"), F.max_by(o, "__row").alias("last")]
        for r in df.groupBy("__chunk").agg(*tests).collect():
            p = r["__chunk"]
            want = min(size, n - p * size) + 1
            if r.n != want and (self.strict or r.n != size + 1):
                self._say("OFFSET_ROW_COUNT", files[p], f"{r.n} rows instead of {want}")
            first, last, down = (r.first, r.last, r.down) if "down" in r else (r.lo, r.hi, 0)
            if first != 0 or down:
                self._say("OFFSET_MONOTONICITY", files[p], "offsets don't rise from 0")
            if per[p] is not None and last != per[p]:
                self._say("OFFSET_TERMINAL", files[p], f"the last offset is {last}, the part has {per[p]} edges")
