"""Dense ids from keys, and edges from keys to ids.

Ids are the ranks of the primary key, so they depend on no partitioning and can be made again. Rows are dealt out by ranges of the
key and sorted inside; that order is checkpointed, sizes of the ranges are summed, and each row adds its place to its range's start. No task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.types import DST, EID, SRC, VID
from ..session import materialize


def dense_ids(df: DataFrame, order: list[str], name: str = VID) -> DataFrame:
    """df with a column of ids 0, 1, 2, ... in the order of the columns `order`."""
    columns = [F.col(f"`{c}`") for c in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id()))
    low = F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1))  # the place inside a task
    starts, before = [], 0
    for task, n in sorted(tuple(r) for r in ranged.groupBy("__range").agg(F.count("*")).collect()):  # a row a task
        starts.append((task, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + low).select(*[F.col(f"`{c}`") for c in df.columns], name)


class DuplicateKey(ValueError):
    pass


def check_keys(df: DataFrame, key: str) -> None:
    """Null and repeated keys are errors."""
    if not df.where(F.col(f"`{key}`").isNull()).isEmpty():
        raise ValueError(f"null keys in {key}")
    twice = df.groupBy(f"`{key}`").count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateKey(f"the key {twice[0][0]!r} is there {twice[0][1]} times")


class MissingEnd(ValueError):
    pass


class IndexGenerator:
    @staticmethod
    def vertex_index_column(df: DataFrame, key: str | None = None) -> DataFrame:
        return dense_ids(df, [key or df.columns[0]])

    @staticmethod
    def vertex_index_and_mapping(df: DataFrame, key: str = "", check: bool = True) -> tuple[DataFrame, DataFrame]:
        """The frame with ids, and (key, vid). The key is the first column unless named."""
        key = key or df.columns[0]
        if check:
            check_keys(df, key)
        indexed = dense_ids(df, [key])  # its rows are checkpointed already; what is left to do is a sum
        return indexed, IndexGenerator.mapping(indexed, key)

    @staticmethod
    def mapping(df: DataFrame, key: str) -> DataFrame:
        """(key, vid) of a frame that has ids."""
        return df.select(F.col(f"`{key}`").alias("key"), VID)

    @staticmethod
    def edge_index_column(df: DataFrame) -> DataFrame:
        """eid in the order of the ends, then of all other columns."""
        ends = [c for c in (SRC, DST) if c in df.columns] or df.columns[:2]
        return dense_ids(df, [*ends, *[c for c in df.columns if c not in ends]], EID)

    @staticmethod
    def _by_mapping(df: DataFrame, column: str, mapping: DataFrame, name: str, strict: bool) -> DataFrame:
        if strict and not (lost := df.join(mapping, F.col(f"`{column}`") == F.col("key"), "left_anti").limit(1)).isEmpty():
            raise MissingEnd(f"no vertex has the key {lost.first()[column]!r}")
        m = mapping.select(F.col("key").alias("__key"), F.col(VID).alias("__vid"))
        return df.join(m, F.col(f"`{column}`") == F.col("__key")).drop("__key", column).withColumnRenamed("__vid", name)

    @staticmethod
    def src_by_mapping(df: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
        """The key column becomes src; edges without a vertex vanish, or are an error if strict."""
        return IndexGenerator._by_mapping(df, column, mapping, SRC, strict)

    @staticmethod
    def dst_by_mapping(df: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
        return IndexGenerator._by_mapping(df, column, mapping, DST, strict)

    @staticmethod
    def edges_by_mapping(df: DataFrame, src_map: DataFrame, dst_map: DataFrame, src: str = "", dst: str = "", strict: bool = False) -> DataFrame:
        """Both ends; the first two columns unless named. Ends come first in the result."""
        src, dst = src or df.columns[0], dst or df.columns[1]
        rest = [c for c in df.columns if c not in (src, dst)]
        out = df.select(F.col(f"`{src}`").alias("__s"), F.col(f"`{dst}`").alias("__d"), *[F.col(f"`{c}`") for c in rest])
        out = IndexGenerator.src_by_mapping(out, "__s", src_map, strict)
        out = IndexGenerator.dst_by_mapping(out, "__d", dst_map, strict)
        return out.select(SRC, DST, *[F.col(f"`{c}`") for c in rest])

    @staticmethod
    def _own(df: DataFrame, columns: list[str]) -> DataFrame:
        keys = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("key")).where("key IS NOT NULL").distinct()
        return materialize(dense_ids(keys, ["key"]))

    @staticmethod
    def src_of_edges(df: DataFrame, column: str = "") -> DataFrame:
        """Ids made from the distinct values of the column itself."""
        column = column or df.columns[0]
        return IndexGenerator.src_by_mapping(df, column, IndexGenerator._own(df, [column]))

    @staticmethod
    def dst_of_edges(df: DataFrame, column: str = "") -> DataFrame:
        column = column or df.columns[1]
        return IndexGenerator.dst_by_mapping(df, column, IndexGenerator._own(df, [column]))

    @staticmethod
    def ends_of_edges_separately(df: DataFrame, src: str = "", dst: str = "") -> DataFrame:
        src, dst = src or df.columns[0], dst or df.columns[1]
        return IndexGenerator.edges_by_mapping(df, IndexGenerator._own(df, [src]), IndexGenerator._own(df, [dst]), src, dst)

    @staticmethod
    def ends_of_edges_unitedly(df: DataFrame, src: str = "", dst: str = "") -> DataFrame:
        """Both ends share one space of ids, made from the distinct values of the two columns."""
        src, dst = src or df.columns[0], dst or df.columns[1]
        both = IndexGenerator._own(df, [src, dst])
        return IndexGenerator.edges_by_mapping(df, both, both.select("key", VID), src, dst)

    @staticmethod
    def string_ids(df: DataFrame, key: str) -> DataFrame:
        """(id string, vid): external ids as text; null and repeated ones are errors."""
        check_keys(df, key)
        return df.select(F.col(f"`{key}`").cast("string").alias("id"), VID)

    @staticmethod
    def extend(known: DataFrame, arriving: DataFrame) -> DataFrame:
        """known (id, vid) with the ids of arriving (id) that it lacks, numbered after its last in order of id."""
        new = arriving.select("id").where("id IS NOT NULL").distinct().join(known, "id", "left_anti")
        last = known.agg(F.coalesce(F.max(VID), F.lit(-1))).first()[0]
        numbered = dense_ids(new, ["id"]).withColumn(VID, F.col(VID) + last + 1)
        return known.select("id", VID).unionByName(numbered.select("id", VID))
