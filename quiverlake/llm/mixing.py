"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Each document has a fixed 48-bit hash of its id. The mix takes a document once for each of the nested thresholds that its
hash is under. Whole passes over a source have the threshold of all hashes; the threshold of the rest is found by summing sizes by
source and hash bucket, taking the bucket in which the budget is reached, and refining that bucket alone, 12 bits at a
time. Documents are then filtered by their own hash: nothing is sorted, and no order of rows matters.

Defined cases: a null or empty text has size 0; a null id has the hash of the empty text; rows with one id are taken together
(they have one hash), so a source's taken words come as near to its target as whole ids allow; a source without words has
target 0; a null source is a source, ordered last; an empty table gives an empty result; texts are counted whole, however long; other columns play no part
and pass through `apply_mix`, whose own columns get another name where theirs is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, lookup, materialize

BITS, STEP = 48, 12


def size_of(text: Column) -> Column:
    """Number of words, runs of anything but the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) with target: all sizes shared by weight, no target above `most` times its source's size.

    One task sorts the sources, a narrow row each. Sources in order of code points, null last, have the weights in turn. Sorted by the share at which they are full, the full sources
    are a prefix; the rest share what these leave.
    """
    every = W.partitionBy()
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    t = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double"))
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("full", F.col("cap") / F.col("w") <= share)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (rest / open_weight))).select("source", "source_size", "target")


def _joined(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    """left with the columns of right's row of the same source; right is broadcast only if its size was checked."""
    if small:
        right = right.withColumnRenamed("source", "of")
        return left.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # a null source is a source; a struct of it joins, and slots split a large one
    key = lambda df: df.withColumn("of", F.struct("source")).drop("source")
    return lookup(key(left), "of", key(right)).withColumn("source", F.col("of.source")).drop("of")


def thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """(source, below): hashes under `below` hold a budget's words, to the nearest hash. budgets: (source, budget > 0)."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for done in range(0, BITS, STEP):
        inside = _joined(sized, state, small).where(F.shiftright("hash", BITS - done) == F.col("prefix"))
        bucket = F.shiftright("hash", BITS - done - STEP).alias("bucket")
        # the state is one row a source, so its columns are constant in a group
        histogram = inside.groupBy("source", bucket).agg(F.sum("size").alias("s"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        up = histogram.withColumn("after", F.col("before") + F.sum("s").over(W.partitionBy("source").orderBy("bucket")))
        at = up.where("after >= budget").groupBy("source").agg(F.min(F.struct("bucket", "after", "s", "budget")).alias("m"))
        state = at.select("source", "m.budget", F.col("m.bucket").alias("prefix"), (F.col("m.after") - F.col("m.s")).alias("before"), F.col("m.after").alias("after"))
        if done + STEP < BITS:
            state = state.drop("after")
    over, under = F.col("after") - F.col("budget"), F.col("budget") - F.col("before")
    return state.select("source", (F.col("prefix") + F.when(over < under, 1).otherwise(0)).alias("below"))


def plan(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, max_broadcast_sources: int = 50_000) -> tuple[DataFrame, bool]:
    """(source, source_size, target, passes, below), a row a source, and whether it is small enough to be broadcast.

    A document is taken `passes` times, and once more if its hash is under `below`. sized: (source, size, hash), written before.
    """
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    small = sources.count() <= max_broadcast_sources
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = sources.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    rest = thresholds(sized, aims.where("budget > 0").select("source", "budget"), small)
    aims = aims.join(rest.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "budget")
    return materialize(aims.withColumn("below", F.coalesce("below", F.lit(0)))), small


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow table that histograms are made of; the texts are read once for it."""
    return materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("hash")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs; taken = copies x size."""
    sized = _sized(docs, id_col, text_col, source_col)
    aims, small = plan(sized, **options)
    out = _joined(sized, aims, small).withColumn("copies", F.col("passes") + (F.col("hash") < F.col("below")).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with two more columns: copies (how often) and taken (words, repeats counted).

    Each row is judged by its own hash and its source's thresholds, so texts are never shuffled.
    """
    copies, taken, of, passes, below = (fresh(docs, x) for x in ("copies", "taken", "mix_source", "mix_passes", "mix_below"))
    aims, small = plan(_sized(docs, id_col, text_col, source_col), **options)
    aims = aims.select(F.col("source").alias(of), F.col("passes").alias(passes), F.col("below").alias(below))
    if small:
        joined = docs.join(F.broadcast(aims), F.col(f"`{source_col}`").eqNullSafe(F.col(of)))
    else:
        keyed = docs.withColumn(of, F.struct(F.col(f"`{source_col}`").alias("source")))
        joined = lookup(keyed, of, aims.withColumn(of, F.struct(F.col(of).alias("source"))))
    chosen = joined.withColumn(copies, F.col(passes) + (hash_of(F.col(f"`{id_col}`")) < F.col(below)).cast("long")).where(F.col(copies) > 0)
    return chosen.withColumn(taken, F.col(copies) * size_of(F.col(f"`{text_col}`"))).drop(of, passes, below)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
s2 AS (SELECT *, cap / w <= (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS full_up
       FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE w * ((total - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0)) / (sum(CASE WHEN NOT full_up THEN w END) OVER ())) END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM s3),
c AS (SELECT d.*, s4.source_size, s4.target, s4.passes, s4.target - s4.passes * s4.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS tied
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
edge AS (SELECT source AS origin, min(h) AS edge_h FROM c WHERE budget > 0 AND upto >= budget GROUP BY source),
cut AS (SELECT DISTINCT origin, edge_h + CASE WHEN upto - budget < budget - (upto - tied) THEN 1 ELSE 0 END AS below FROM edge JOIN c ON c.source IS NOT DISTINCT FROM origin AND h = edge_h)
SELECT doc_id, size, source_size, target, ((passes + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c LEFT JOIN cut ON c.source IS NOT DISTINCT FROM cut.origin
"""
