"""The chunk sink: rows that carry a chunk's keys become exactly one file a chunk, under the chunk's own name.

Rows are dealt by a hash that is made here and into a number of tasks that is fixed here. No frame can already be dealt that way, so neither the
planner (which drops a repartition that its child seems to fulfil, as a union of frames dealt by the same keys does) nor the coalescing of small
partitions can leave a chunk in two tasks.

Spark's writers write one file for each combination of keys into a staging folder, with Spark's commit protocol, so retried
and speculative tasks leave nothing behind; the driver then renames committed files. A chunk is one task's work at most, as its size is bounded by the metadata.

Many small Parquet chunks on a file system that is mounted (file:) are written by pyarrow instead, as there the cost is that of a file and not that of
a row: an attempt writes into a staging folder of its own and names its files in its result, so that only attempts that count are known; when all rows
are written, tasks rename the files. Rows, order, names and replacement are the same.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import pairwise
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.types import FileType
from ..session import POOL, Store
from ..sources.aligned import PLAIN


#: A task writes about this many chunks at most, one after the other.
CHUNKS_A_TASK = 64
#: More chunks than this, of at most so many rows, are many and small; a task writes about so many of these at most.
MANY, SMALL, SMALL_A_TASK = 64, 4096, 512


def tasks_for(spark: SparkSession, chunks: int | None, a_task: int = CHUNKS_A_TASK) -> int:
    """How many tasks write so many chunks: the session's shuffle partitions, fewer for few chunks and more for very many."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return usual if chunks is None else max(1, min(chunks, max(usual, -(-chunks // a_task))))


def _local(path: str) -> str:
    return re.sub(r"^file:(//[^/]*)?(?=/)", "", path)


def _write_files(batches: Iterator, keys: int, folder: str) -> Iterator:
    """Rows that are sorted by their first `keys` columns: the other columns of each combination into a file of its own, named 0, 1, 2, ...

    Yields one row: the attempt's folder, and the combinations one after the other as longs."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    own, now, writer, made = f"{folder}/{uuid4().hex}", None, None, []
    os.makedirs(own)
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        rows = pa.RecordBatch.from_arrays(batch.columns[keys:], names=batch.schema.names[keys:])
        cuts = (np.flatnonzero((found[:, 1:] != found[:, :-1]).any(axis=0)) + 1).tolist()
        for first, end in pairwise([0, *cuts, batch.num_rows]):
            if (key := tuple(found[:, first].tolist())) != now:
                if writer is not None:
                    writer.close()
                now, writer = key, pq.ParquetWriter(f"{own}/{len(made)}", rows.schema, compression="zstd", store_schema=False)
                made.append(key)
            writer.write_batch(rows.slice(first, end - first))
    if writer is not None:
        writer.close()
    yield pa.RecordBatch.from_pydict({"folder": [own], "keys": [np.array(made, dtype=np.int64).tobytes()]})


def _named(batches: Iterator, keys: int, name_of: Callable[..., str]) -> Iterator[tuple[str, str]]:
    """(file in an attempt's folder, the chunk's own) of what `_write_files` yields."""
    import numpy as np

    for batch in batches:
        for folder, held in zip(batch.column("folder").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            for i, key in enumerate(np.frombuffer(held, dtype=np.int64).reshape(-1, keys).tolist()):
                yield f"{folder}/{i}", _local(name_of(*key))


def _move(old: str, new: str, made: set[str]) -> None:
    """A retried task finds some files moved already. The checksum that Hadoop keeps beside a file would be that of the old one."""
    place, _, name = new.rpartition("/")
    if place not in made:
        os.makedirs(place, exist_ok=True)
        made.add(place)
    try:
        os.unlink(f"{place}/.{name}.crc")
    except FileNotFoundError:
        pass
    try:
        os.replace(old, new)
    except FileNotFoundError:
        if not os.path.exists(new):
            raise


def _write_small(data: DataFrame, keys: int, name_of: Callable[..., str], staging: str, replace: bool) -> list[tuple]:
    import numpy as np

    spark, folder = data.sparkSession, _local(staging)

    def write(batches: Iterator) -> Iterator:
        yield from _write_files(batches, keys, folder)

    def there(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, name in _named(batches, keys, name_of):
            if os.path.exists(name):
                yield pa.RecordBatch.from_pydict({"name": [name]})
                return

    def move(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: set[str] = set()
        for old, new in _named(batches, keys, name_of):
            _move(old, new, made)
        yield pa.RecordBatch.from_pydict({"name": [""]})

    done = [(r[0], bytes(r[1])) for r in data.mapInArrow(write, "folder string, keys binary").collect() if r[1]]  # a row a task
    if not done:
        return []
    files = spark.createDataFrame(done, "folder string, keys binary")
    if not replace and (names := files.mapInArrow(there, "name string").take(1)):
        raise FileExistsError(names[0][0])
    files.mapInArrow(move, "name string").collect()
    return sorted(tuple(k) for _, held in done for k in np.frombuffer(held, dtype=np.int64).reshape(-1, keys).tolist())


def write_chunks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    kind: FileType,
    base: str,
    name_of: Callable[..., str],
    replace: bool = True,
    chunks: int | None = None,
    rows: int | None = None,
) -> list[tuple]:
    """Write columns of df by chunk: each combination of the long columns `keys` is the file name_of(*keys), its rows in `order`.

    Returns the keys written. With replace False a chunk that is there already is an error, before anything is renamed. chunks: about how many
    there will be, rows: how many rows one has at most, if these are known. name_of is sent to tasks, so it must hold no session or frame.
    """
    spark, store = df.sparkSession, Store(df.sparkSession)
    staging = f"{base.rstrip('/')}/.staging-{uuid4().hex}"
    hidden = [f"__key{i}" for i in range(len(keys))]
    places = [f"__order{i}" for i in range(len(order))]
    data = df.select(
        *[F.col(k).alias(h) for k, h in zip(keys, hidden, strict=True)],
        *[F.col(o).alias(h) for o, h in zip(order, places, strict=True)],
        *[F.col(f"`{c}`") for c in columns],
    )
    small = kind is FileType.PARQUET and (chunks or 0) > MANY and rows is not None and rows <= SMALL
    small = small and all(isinstance(data.schema[c].dataType, PLAIN) for c in columns) and _local(base).startswith("/") and store.scheme(base) == "file"
    data = data.withColumn("__deal", F.xxhash64(F.lit("chunk"), *hidden)).repartition(tasks_for(spark, chunks, SMALL_A_TASK if small else CHUNKS_A_TASK), "__deal")
    data = data.sortWithinPartitions(*hidden, *places)
    if small:
        try:
            return _write_small(data.drop("__deal", *places), len(keys), name_of, staging, replace)
        finally:
            store.delete(staging)
    writer = data.drop("__deal", *places).write.partitionBy(*hidden)
    if kind in (FileType.PARQUET, FileType.ORC):
        writer = writer.option("compression", "zstd")
    if kind is FileType.CSV:
        writer = writer.option("header", "true")
    if kind is FileType.JSON:
        writer = writer.option("ignoreNullFields", "false")
    try:
        writer.format(kind.value).save(staging)

        made = []
        for path in store.files(staging):
            *folders, name = path.rsplit("/", len(keys) + 1)[1:]
            if name.startswith("part-"):
                made.append((tuple(int(x.split("=")[1]) for x in folders), path))
        if len({k for k, _ in made}) < len(made):
            raise RuntimeError("a chunk was written as more than one file; unset spark.sql.files.maxRecordsPerFile")
        if not replace and (there := [k for k, _ in made if store.exists(name_of(*k))]):
            raise FileExistsError(name_of(*there[0]))
        list(POOL.map(lambda x: store.rename(x[1], name_of(*x[0])), made))
        return sorted(k for k, _ in made)
    finally:
        store.delete(staging)
