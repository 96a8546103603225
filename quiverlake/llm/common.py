"""Helpers that several operators share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release

__all__ = ["bounded", "fold", "fresh", "labelled_sample", "lookup", "materialize", "others", "read_table", "release", "text_bytes", "WORD_BYTES"]

#: ASCII letters and digits and every byte of a non-ASCII character are kept, A-Z lower-cased, the rest turned to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader, so that any Hadoop path works.

    Python workers that this machine starts find the package too; a cluster gets it by PYTHONPATH or --py-files.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but for those that are named like a result, in any case of their letters; results take their place."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


#: Into how many tasks the rows of one very frequent value are dealt.
SLOTS = 32


def lookup(left: DataFrame, key: str, right: DataFrame, how: str = "inner", slots: int = SLOTS) -> DataFrame:
    """left with the columns of right's one row of the same `key` (how: inner or left), however many rows of left share a key.

    Rows of left are dealt by key and by a slot, a hash of the whole row; each key and slot fetches its row of right once. So a key that holds a third of all
    rows is spread over `slots` tasks, and right is met by no more than `slots` rows of it.
    """
    slot = fresh(left, "slot")
    dealt = left.withColumn(slot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(slots)))
    found = dealt.select(key, slot).distinct().join(right, key)
    return dealt.join(found, [key, slot], how).drop(slot)


def text_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(modulus))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int, keep: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents of at most max_rows labelled ids as (id, y, text), the ids chosen by a hash, so reruns agree.

    Null ids and null labels are left out; an id labelled more than once counts by its mean, a half as 1. The labels are
    narrow and bounded by max_rows, so broadcasting them is safe whatever the size of the corpus. An id may have any number of documents: callers
    bound what they make of them with `bounded`.
    """
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & keep)
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(order, "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "y", "text")


def bounded(made: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows rows of what was made of a labelled sample: repeated rows once, and of too many those of the smallest hashes."""
    return made.distinct().orderBy(F.xxhash64(F.lit("bound"), *made.columns), *made.columns).limit(max_rows)
