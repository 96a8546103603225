"""Label filters over Boolean label columns, of which a scan reads only those that are asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.types import LABELS, VID


def label_columns(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(vid, one Boolean column a label) from a frame with :LABEL."""
    return df.select(VID, *[F.coalesce(F.array_contains(F.col(f"`{LABELS}`"), F.lit(x)), F.lit(False)).alias(x) for x in labels])


def with_labels(df: DataFrame, labels: Sequence[str], any_of: bool = False, within: DataFrame | None = None) -> DataFrame:
    """Ascending ids of vertices that have all, or any, of the labels. df: (vid, Boolean columns); unknown labels are errors."""
    if not labels:
        raise ValueError("no label")
    for x in labels:
        if x not in df.columns:
            raise KeyError(f"no label {x}")
    test = reduce(or_ if any_of else and_, [F.col(f"`{x}`") for x in labels])
    ids = df.where(test).select(VID)
    if within is not None:
        ids = ids.join(within.select(VID).distinct(), VID, "left_semi")
    return ids.orderBy(VID)


def count_of(ids: DataFrame) -> DataFrame:
    return ids.agg(F.count("*").alias("n"))


def bitmap_of(ids: DataFrame) -> DataFrame:
    """(bucket, bitmap, n): 32,768 ids a row; bit i of bucket b stands for the id 32,768 (b - 1) + i."""
    at = F.col(VID) + 1
    return ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"), F.count("*").alias("n"))


def label_query(df: DataFrame, labels: Sequence[str], result: str = "index", any_of: bool = False) -> DataFrame:
    ids = with_labels(df, labels, any_of)
    if result not in ("count", "index", "bitmap"):
        raise ValueError("the result is count, index or bitmap")
    return {"count": count_of, "index": lambda x: x, "bitmap": bitmap_of}[result](ids)


def has_label(df: DataFrame, vid: int, label: str) -> DataFrame:
    """One row: whether a vertex has a label. df: (vid, :LABEL)."""
    return df.where(F.col(VID) == vid).select(VID, F.array_contains(F.col(f"`{LABELS}`"), F.lit(label)).alias("has_label"))


def labels_of(df: DataFrame, vid: int) -> DataFrame:
    return df.where(F.col(VID) == vid).select(VID, LABELS)
