"""What a read asks for and what the plan does of it: which filters and columns reach the scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import Expression, compile_filter
from .types import VID


@dataclass(frozen=True)
class ReadRequest:
    """columns, a half-open range of ids, a filter and a limit; all optional."""

    columns: tuple[str, ...] | None = None
    rows: tuple[int, int] | None = None
    where: Expression | None = None
    limit: int | None = None
    nulls: str = "two"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.rows is not None:
            df = df.where((F.col(VID) >= self.rows[0]) & (F.col(VID) < self.rows[1]))
        if self.where is not None:
            df = df.where(compile_filter(self.where, df.schema, self.nulls))
        if self.columns is not None:
            df = df.select(*self.columns)
        return df if self.limit is None else df.limit(self.limit)


@dataclass(frozen=True)
class ReadReport:
    pushed_filters: tuple[str, ...]
    read_columns: tuple[str, ...]
    scans: int


def report(df: DataFrame) -> ReadReport:
    """Read off the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString() if hasattr(df, "_jdf") else ""
    pushed = [x for m in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S) for x in re.split(r",\s*(?=[A-Z])", m) if x]
    read = [x.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", plan, re.S) for x in re.split(r",(?![^<(]*[>)])", m) if x]
    return ReadReport(tuple(pushed), tuple(dict.fromkeys(read)), len(re.findall(r"FileScan|BatchScan", plan)))
