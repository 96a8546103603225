"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints at `distance` or fewer differing bits agree in at least 8 - distance of their 8 positional bytes. The
index posts each distinct fingerprint under sets of positional bytes; two that agree in 4 bytes or more share at least one
of the 20 posted triples (a covering of all 4-sets of positions). Inside a posting list the shared bytes are tallied for each pair, pairs
that reach the guaranteed minimum are kept, and their differing bits are counted.

A posting list longer than `block` is split by hash into blocks, and each pair of blocks is a task of its own, so a hot
group of near copies never meets in one task; a task emits a spanning forest of the links it finds, never all pairs. Exact copies are one fingerprint.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero, which is linked like any other; fewer words
than a shingle make one shingle; repeated rows and ids have equal fingerprints; a null id never names a component unless
all its members are null; an empty table gives an empty result; very long texts are hashed whole, a slice of shingles at a time; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, lookup, materialize, others, release, text_bytes
from .components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def cover() -> list[tuple[int, ...]]:
    """20 triples of the 8 positions such that every 4 positions contain one of them.

    The positions form three rings of 3, 3 and 2; a triple is posted if it lies inside one ring, or has two positions in a
    ring and one in the next.
    """
    ring = (0, 0, 0, 1, 1, 1, 2, 2)
    wanted = []
    for t in combinations(range(8), 3):
        n = [sum(ring[p] == r for p in t) for r in range(3)]
        if 3 in n or any(n[r] == 2 and n[(r + 1) % 3] == 1 for r in range(3)):
            wanted.append(t)
    return wanted


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text's UTF-8 bytes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.concatenate(([0], np.cumsum(length + 1)))
    end = start[size : size + n] - 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter(
            (xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[at : min(at + 65536, n)].tolist(), end[at : at + 65536].tolist(), strict=True)), dtype=np.uint64
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", shingle: int = 4, seed: int = 42) -> DataFrame:
    """docs without its text but with one more column `out`: the fingerprint's bits as a long."""
    kept = docs.select(*others(docs, text_col, out), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column(batch.num_columns - 1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made.view(np.int64))], names=[*[f.name for f in batch.schema][:-1], out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField(out, T.LongType())]))


def _alike(x, distance: int):
    """Which of the XORed fingerprints x agree in enough positional bytes and, verified, differ in few enough bits."""
    import numpy as np

    tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    near = tally >= 8 - distance
    near[near] = np.bitwise_count(x[near]) <= distance
    return near


def _forest(a, b):
    """A spanning forest (node, root) of the links a-b."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links_of(list_id, block, cross, fp, distance: int, small: int = 48):
    """Links inside complete posting lists that stand one after the other. cross: only pairs of different blocks count."""
    import numpy as np

    n = len(fp)
    first = np.nonzero(np.concatenate(([True], list_id[1:] != list_id[:-1])))[0]
    size = np.diff(np.append(first, n))
    found_a, found_b = [], []
    little = np.repeat(size <= small, size)
    left = np.nonzero(little)[0]
    end = np.repeat(first + size, size)
    shift = 1
    while len(left):  # every pair at this distance within its list, for all short lists at once
        left = left[left + shift < end[left]]
        right = left + shift
        if len(left):
            ok = _alike(fp[left] ^ fp[right], distance) & ~(cross[left] & (block[left] == block[right]))
            found_a.append(fp[left[ok]])
            found_b.append(fp[right[ok]])
        shift += 1
    for s, m in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
        own = fp[s : s + m]
        half = int(np.count_nonzero(block[s : s + m] == block[s])) if cross[s] else m
        rows, columns = (own[:half], own[half:]) if cross[s] else (own, own)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            i, j = np.nonzero(_alike(part[:, None] ^ columns[None, :], distance))
            keep = slice(None) if cross[s] else (i + at < j)
            found_a.append(part[i[keep]])
            found_b.append(columns[j[keep]])
            if len(found_a) > 64:
                a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [a], [b]
    if not found_a:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, fp: str = "fp", distance: int = 4, block: int = 2048) -> DataFrame:
    """Links (a, b) that connect all fingerprints at `distance` or fewer differing bits; distinct: each fingerprint once."""
    if not 0 <= distance <= 4:
        raise ValueError("the posted triples guarantee distances up to 4")
    byte = lambda p: 0xFF << (8 * p)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(byte(p) for p in t)) for t in cover()]
    posts = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    index = distinct.select(F.col(fp).alias("fp"), F.inline(posts))
    shared = index.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    posted = index.join(shared, ["t", "key"])
    blocks = F.ceil(F.col("n") / block)
    own = posted.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = own.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    dealt = dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "own", "fp")

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        kept = None

        def solve(rows):
            name = np.concatenate(([0], np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))))
            a, b = _links_of(name, rows[4], rows[2] != rows[3], rows[5].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            if not rows.shape[1]:
                continue
            change = np.nonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))[0]
            cut = change[-1] + 1 if len(change) else 0  # the last list may go on in the next batch; it has 2 blocks at most
            kept = rows[:, cut:]
            if cut:
                yield solve(np.ascontiguousarray(rows[:, :cut]))
        if kept is not None and kept.shape[1]:
            yield solve(np.ascontiguousarray(kept))

    return dealt.mapInArrow(run, "a long, b long")


def _placed(rows: DataFrame, least, distance: int) -> DataFrame:
    """(fp, chosen): for each distinct fingerprint of rows, the smallest `least` of all rows in its component."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(least).alias("least")))
    roots = connected_components(links(distinct, "fp", distance))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    release(distinct, roots)
    named = placed.groupBy("root").agg(F.min("least").alias("chosen"))
    return lookup(placed.select("fp", "root"), "root", named).select("fp", "chosen")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(id_col, fp long, component): one row per row of docs; component is the smallest id that links reach."""
    rows = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text", "fp", shingle, seed))
    placed = _placed(rows, F.col("id"), distance)
    return lookup(rows, "fp", placed).select(F.col("id").alias(id_col), "fp", F.col("chosen").alias("component"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42, max_broadcast_rows: int = 1_000_000
) -> DataFrame:
    """docs with one row of each component: that of the smallest id, nulls last; of rows that repeat id and text, one stays.

    The columns are those of docs. Rows are named by id and 128 bits of hashes of the text, so repeated ids with different texts are told apart. Only
    names to drop (and names that repeat, of which one row stays) are joined to the texts: broadcast up to max_broadcast_rows, about 40 bytes each, so that texts
    stay where they are; beyond that texts are dealt once.
    """
    names = lambda i, t: F.struct(i.alias("id"), F.xxhash64(t).alias("th"), F.xxhash64(F.lit("name"), t).alias("tg"))
    rows = fingerprints(docs.select(names(F.col(id_col), F.col(text_col)).alias("name"), F.col(text_col).alias("__text")), "__text", "fp", shingle, seed)
    rows = materialize(rows)
    order = F.struct(F.col("name.id").isNull().alias("last"), F.col("name"))
    placed = _placed(rows, order, distance)
    decided = lookup(rows, "fp", placed).groupBy("name").agg((F.first("chosen")["name"] == F.col("name")).alias("stays"), F.count("*").alias("n"))
    named = materialize(decided.where("NOT stays OR n > 1"))
    release(rows)
    sizes = {r.stays: r.n for r in named.groupBy("stays").agg(F.count("*").alias("n")).collect()}
    key = fresh(docs, "row_name")
    joinable = lambda df: F.broadcast(df) if sum(sizes.values()) <= max_broadcast_rows else df
    marked = docs.withColumn(key, names(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    kept = marked.join(joinable(named.select(F.col("name").alias(key))), key, "left_anti")
    if sizes.get(True):  # the rows that repeat are few or pre-aggregated before they are dealt
        once = marked.join(joinable(named.where("stays").select(F.col("name").alias(key))), key, "left_semi")
        kept = kept.unionByName(once.dropDuplicates([key]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
