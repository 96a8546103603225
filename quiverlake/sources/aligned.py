"""A source of chunks, one task a chunk: the files of several groups of one chunk are read side by side, in batches.

Groups of one type hold the same rows in the same order, so a row of one belongs to the row at the same place of the others. Reading them
together needs no join, thus no shuffle and no sort, whatever the number of rows. Only the columns asked for are decoded, a batch at a time.

Files are opened by pyarrow in the executors. Where it can't open them (another file system, a text format, a type that it would read otherwise)
the readers join the groups by place instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.types import FileType

BATCH, SMALL = 32_768, 4096
PLAIN = (T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.DateType)
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


@dataclass(frozen=True)
class Files:
    """The files of one group: a folder, and the columns as (name in the file, or `*Ending` of a reserved one, name in the frame)."""

    folder: str
    kind: FileType
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Chunks:
    """Which chunks: for each part (None where files have no parts) how many, and the place of its first row."""

    parts: tuple[int | None, ...]
    counts: tuple[int, ...]
    starts: tuple[int, ...]
    size: int
    first: int = 0  # the first chunk of each part


def _opened(path: str):
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(at.path) if at.scheme else path)
    system, inner = fs.FileSystem.from_uri(f"{SCHEMES.get(at.scheme, at.scheme)}://{at.netloc}{at.path}")
    return system.open_input_file(inner)


def can_align(files: Sequence[Files], schema: T.StructType, first: str) -> bool:
    """first: the path of a file that is there."""
    if any(f.kind not in (FileType.PARQUET, FileType.ORC) for f in files) or not all(isinstance(f.dataType, PLAIN) for f in schema.fields):
        return False
    if urlparse(first).scheme in ("", "file"):
        return True
    try:
        _opened(first).close()
    except Exception:  # noqa: BLE001  whatever the file system's reason, there is another way
        return False
    return True


def _batches(path: str, f: Files) -> Iterator[list]:
    """The asked-for columns of one file, batch by batch."""
    import re

    def place(names: list[str], wanted: str) -> str:
        if not wanted.startswith("*"):
            return wanted
        return next(n for n in names if re.fullmatch(rf"_[A-Za-z]+?{wanted[1:]}", n))

    with _opened(path) as stream:
        if f.kind is FileType.PARQUET:
            import pyarrow.parquet as pq

            file = pq.ParquetFile(stream)
            names = [place(file.schema_arrow.names, c) for c, _ in f.columns]
            if file.metadata.num_rows <= SMALL:  # at once, as the time goes into the file and not into its rows
                table = file.read(names, use_threads=False).combine_chunks()
                if table.num_rows:
                    yield [table.column(n).chunk(0) for n in names]
                return
            for batch in file.iter_batches(BATCH, columns=names):
                yield [batch.column(n) for n in names]
        else:
            from pyarrow import orc

            file = orc.ORCFile(stream)
            names = [place(file.schema.names, c) for c, _ in f.columns]
            for stripe in range(file.nstripes):
                batch = file.read_stripe(stripe, columns=names)
                yield [batch.column(n) for n in names]


def _zipped(sides: list[Iterator[list]], name: str) -> Iterator[list]:
    """Batches of equal length with the columns of all sides."""
    held: list[list | None] = [None] * len(sides)
    while True:
        for i, side in enumerate(sides):
            while held[i] is None or not len(held[i][0]):
                held[i] = next(side, None)
                if held[i] is None:
                    break
        if all(h is None for h in held):
            return
        if any(h is None for h in held):
            raise ValueError(f"the groups of {name} have different numbers of rows")
        n = min(len(h[0]) for h in held)
        yield [c.slice(0, n) for h in held for c in h]
        held = [[c.slice(n) for c in h] for h in held]


def _unsized(df: DataFrame) -> DataFrame:
    """The same rows by way of an RDD, whose size the planner doesn't claim to know.

    It takes what is mapped to be about as large as what it is mapped from. From the numbers of some chunks it would conclude that their rows, however many,
    are a few bytes, and broadcast them through the driver; of unknown ones only those are broadcast that were small when they ran."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), spark)


def side_by_side(spark: SparkSession, files: Sequence[Files], chunks: Chunks, schema: T.StructType, index: str | None = None) -> DataFrame:
    """The rows of the chunks with the columns of all files; index: also a column of that name with each row's place."""
    from pyspark.sql.pandas.types import to_arrow_type

    files, fields = list(files), list(schema.fields)
    if index is not None:
        schema = T.StructType([*fields, T.StructField(index, T.LongType())])
    total = sum(chunks.counts)
    if not total:
        return spark.createDataFrame([], schema)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [n for f in files for _, n in f.columns]
    order = [names.index(f.name) for f in fields]
    out = [f.name for f in schema.fields]

    def run(numbers: Iterator):
        import numpy as np
        import pyarrow as pa

        def joined(held: list[list]):  # rows of many small chunks are one batch
            return pa.RecordBatch.from_arrays([c[0] if len(c) == 1 else pa.concat_arrays(c) for c in zip(*held, strict=True)], names=out)

        ends, held, waiting = np.cumsum(chunks.counts), [], 0
        for batch in numbers:
            for i in batch.column(0).to_pylist():
                p = int(np.searchsorted(ends, i, side="right"))
                chunk = chunks.first + i - int(ends[p]) + chunks.counts[p]
                name = ("" if chunks.parts[p] is None else f"part{chunks.parts[p]}/") + f"chunk{chunk}"
                row = chunks.starts[p] + chunk * chunks.size
                for columns in _zipped([_batches(f.folder + name, f) for f in files], name):
                    made = [c if (c := columns[at]).type == kind else c.cast(kind) for at, kind in zip(order, kinds, strict=True)]
                    if index is not None:
                        made.append(pa.array(np.arange(row, row + len(columns[0]), dtype=np.int64)))
                    row += len(columns[0])
                    held.append(made)
                    waiting += len(columns[0])
                    if waiting >= BATCH:
                        yield joined(held)
                        held, waiting = [], 0
        if held:
            yield joined(held)

    tasks = min(total, max(4 * spark.sparkContext.defaultParallelism, total // max(8, BATCH // chunks.size)))  # a task has 8 chunks, or a batch of rows
    return _unsized(spark.range(0, total, 1, tasks).select("id")).mapInArrow(run, schema)
