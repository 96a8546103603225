"""Session helpers: checkpoints and files of any store that Hadoop reaches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a single machine a temporary one where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quiverlake-"))
    return named or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Delete the files of frames that materialize() returned and that nothing will read again; other frames are left as they are."""
    for df in frames:
        plan = None if df is None else df._jdf.queryExecution().logical()
        if plan is None or plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            Store(df.sparkSession).delete(file.get())


def checksum(df: DataFrame) -> dict[str, int]:
    """Number and hashes of the rows, whatever their order and partitioning. Repeated rows count: they cancel out in `xor`, not in `sum`."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    row = df.agg(F.count("*").alias("rows"), F.bit_xor(hashed).alias("xor"), F.sum(F.pmod(hashed, F.lit(1 << 20))).alias("sum")).first()
    return {"rows": row["rows"], "xor": row["xor"] or 0, "sum": row["sum"] or 0}


#: Threads that work on small files side by side. They are kept, as each holds a connection to the JVM.
POOL = ThreadPoolExecutor(8, thread_name_prefix="quiverlake-files")
_JOBS = ThreadPoolExecutor(4, thread_name_prefix="quiverlake-jobs")


def side_by_side(*jobs: Callable[[], object]) -> None:
    """Run Spark jobs that don't depend on each other at the same time; the first error is raised after all have ended."""
    running = [_JOBS.submit(job) for job in jobs]
    wait(running)
    for one in running:
        one.result()


class Store:
    """Small files and renames on any Hadoop file system, from the driver."""

    _classes: dict[int, tuple] = {}

    def __init__(self, spark: SparkSession):
        self.spark, jvm = spark, spark.sparkContext._jvm
        if id(jvm) not in Store._classes:  # each dot of a class name is a call to the JVM
            kept = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
            Store._classes.clear()
            Store._classes[id(jvm)] = (jvm, *kept)
        _, self._path, self._io = Store._classes[id(jvm)]
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._systems: dict[str, object] = {}

    def _at(self, path: str):
        p = self._path(path)
        root = path.split("/", 3)[:3] if "://" in path else path.split(":", 1)[:1] if ":" in path else [""]
        fs = self._systems.get("/".join(root))
        if fs is None:
            fs = self._systems["/".join(root)] = p.getFileSystem(self._conf)
        return fs, p

    def scheme(self, path: str) -> str:
        """Of the file system that holds the path, also where the path names none."""
        return self._at(path)[0].getUri().getScheme()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, path: str, data: bytes, overwrite: bool = True) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8")

    def write_text(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode("utf-8"))

    def list(self, path: str) -> list[tuple[str, bool, int]]:
        """(path, is it a folder, length) of what a folder holds, by name; nothing if it isn't there."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))

    def files(self, path: str) -> list[str]:
        """All files under a folder."""
        fs, p = self._at(path)
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            out.append(found.next().getPath().toString())
        return out

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)  # False if it isn't there

    def rename(self, old: str, new: str) -> None:
        """new is replaced if it is there: it is moved aside under a hidden name first and deleted last, so a crash loses neither."""
        fs, a = self._at(old)
        _, b = self._at(new)
        fs.mkdirs(b.getParent())
        aside = None
        if fs.exists(b):
            aside = self._path(b.getParent(), f".{b.getName()}.old-{uuid4().hex}")
            if not fs.rename(b, aside):
                raise OSError(f"{new} can't be moved aside")
        if not fs.rename(a, b):
            if aside is not None:
                fs.rename(aside, b)
            raise OSError(f"{old} can't be renamed to {new}")
        if aside is not None:
            fs.delete(aside, True)
