"""Types, file types, layouts and the reserved columns of an archive."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class FileType(str, Enum):
    PARQUET = "parquet"
    ORC = "orc"
    CSV = "csv"
    JSON = "json"


class Cardinality(str, Enum):
    SINGLE = "single"
    LIST = "list"
    SET = "set"


class Direction(str, Enum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    UNDIRECTED = "undirected"


class AdjListType(str, Enum):
    UNORDERED_BY_SOURCE = "unordered_by_source"
    UNORDERED_BY_DEST = "unordered_by_dest"
    ORDERED_BY_SOURCE = "ordered_by_source"
    ORDERED_BY_DEST = "ordered_by_dest"

    @property
    def ordered(self) -> bool:
        return self.value.startswith("ordered")

    @property
    def by_source(self) -> bool:
        return self.value.endswith("source")

    @classmethod
    def of(cls, ordered: bool, aligned_by: str) -> AdjListType:
        if aligned_by not in ("src", "dst"):
            raise ValueError(f"aligned_by is src or dst, not {aligned_by}")
        return cls(("ordered" if ordered else "unordered") + ("_by_source" if aligned_by == "src" else "_by_dest"))


# The type names of the format and Spark's types for them.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}
LIST_ITEMS = ("int32", "int64", "float", "double", "string")
#: Other spellings that archives hold.
ALIASES = {"int": "int32", "integer": "int32", "long": "int64", "bigint": "int64", "boolean": "bool", "tinyint": "int32", "smallint": "int32", "timestamp_ntz": "timestamp"}


def canonical(name: str) -> str:
    """The canonical spelling of a type name; unknown types, `time` among them, are errors."""
    name = name.strip().lower()
    if m := re.fullmatch(r"(?:list|array)<(.+)>", name):
        item = canonical(m[1])
        if item not in LIST_ITEMS:
            raise ValueError(f"no list of {item}")
        return f"list<{item}>"
    name = ALIASES.get(name, name)
    if name not in TYPES:
        raise ValueError(f"unknown type {name}")
    return name


def spark_type(name: str) -> T.DataType:
    name = canonical(name)
    return T.ArrayType(TYPES[name[5:-1]]) if name.startswith("list<") else TYPES[name]


def type_name(kind: T.DataType) -> str:
    return canonical(kind.simpleString())


def file_type(name: str | FileType) -> FileType:
    return name if isinstance(name, FileType) else FileType(name.lower())


class Reserved:
    """Names of the reserved columns: a prefix, then VertexIndex, SrcIndex, DstIndex, Offset.

    Archives of other writers differ in the prefix alone; `found` reads it off a frame's columns.
    """

    def __init__(self, prefix: str = "_ql"):
        self.prefix = prefix
        self.vertex, self.src, self.dst, self.offset = (prefix + x for x in ("VertexIndex", "SrcIndex", "DstIndex", "Offset"))

    @staticmethod
    def found(columns: list[str], *endings: str) -> list[str]:
        """The reserved column of each ending."""
        out = []
        for ending in endings:
            match = [c for c in columns if re.fullmatch(rf"_[A-Za-z]+{ending}", c)]
            if len(match) != 1:
                raise ValueError(f"no single column _*{ending} among {columns}")
            out.append(match[0])
        return out


#: Names inside this library's frames.
VID, SRC, DST, EID, LABELS = "vid", "src", "dst", "eid", ":LABEL"


def plain_names(df: DataFrame) -> DataFrame:
    """The reserved columns of a chunk under this library's names."""
    names = {"VertexIndex": VID, "SrcIndex": SRC, "DstIndex": DST, "Offset": "offset"}
    for c in df.columns:
        if m := re.fullmatch(r"_[A-Za-z]+?(VertexIndex|SrcIndex|DstIndex|Offset)", c):
            df = df.withColumnRenamed(c, names[m[1]])
    return df
