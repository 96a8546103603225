"""Control files: one 64-bit little-endian number each."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession

from ..session import Store


def write_value(spark: SparkSession, path: str, value: int, store: Store | None = None) -> None:
    if value < 0:
        raise ValueError(f"{path}: negative count {value}")
    (store or Store(spark)).write_bytes(path, struct.pack("<q", value))


def read_value(spark: SparkSession, path: str, store: Store | None = None) -> int:
    data = (store or Store(spark)).read_bytes(path)
    if len(data) != 8:
        raise ValueError(f"{path}: {len(data)} bytes instead of 8")
    value = struct.unpack("<q", data)[0]
    if value < 0:
        raise ValueError(f"{path}: negative count {value}")
    return value
