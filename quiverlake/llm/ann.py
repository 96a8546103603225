"""Approximate nearest neighbours by cosine: low-dimensional stable projections indexed by kd-trees.

Vectors are scaled to length one, so that the squared distance is 2 - 2 x cosine, and projected with `dims` Gaussian (2-stable)
directions: a squared projected distance over the true one is then chi-square with `dims` degrees of freedom. Projected
neighbours are visited in order of projected distance and verified on the original vectors until the chi-square test holds: a vector nearer than the present k-th
would have been projected inside the visited radius with probability `confidence`. With 32 dimensions and a confidence of 0.93 the test
leaves a third or less of vectors without any structure to be verified, and far fewer of vectors that have some (see the README for figures).

The top of the kd-tree is fitted on a bounded sample (`sample` vectors a length) and cuts the space into at most `max_cells` cells; every
vector is put in its cell, and a cell of many vectors (one that is very frequent, say) is split by a hash of the id into
blocks of about `block_rows`. A query first searches one block of its own cell, which bounds its k-th distance; then it
visits the blocks of those cells alone that the same test doesn't rule out. A block with many visits is dealt to several tasks.
Nothing is capped: with fewer than k candidates found a query visits every block.

Work: blocks are compared with all their queries at once, projected distances by one matrix product. The number of blocks that a query visits grows
with the data unless cells are ruled out, which vectors without structure seldom allow.

Defined cases: null ids and vectors, and vectors that are empty, zero or hold null or non-finite components, take no part; vectors
are compared with those of equal length; rows with the query's id are never its candidates; repeated rows count once, and of a candidate id
with several vectors the nearest counts; equal scores are ordered by id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

SEED = 20240607


def chi_square_quantile(p: float, dims: int) -> float:
    """Where the chi-square distribution with an even number of degrees of freedom reaches p; by bisection of its closed form."""
    if dims % 2 or not 0 < p < 1:
        raise ValueError("dims is even and the confidence inside (0, 1)")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(length: int, dims: int):
    import numpy as np

    return np.random.default_rng(SEED + length).standard_normal((length, dims))


def rescaled(a):
    """Rows times a power of two, exactly, so that squares neither overflow nor vanish."""
    import numpy as np

    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1, keepdims=True))[1]) if len(a) else a


def unit(a):
    import numpy as np

    return a / np.sqrt((a * a).sum(axis=1, keepdims=True)) if len(a) else a


class Cells:
    """The top of the kd-tree for vectors of one length: a complete tree of medians; leaves are cells with their bounds."""

    def __init__(self, points, cells: int):
        import numpy as np

        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        dims = points.shape[1]
        self.axis, self.cut = np.zeros((1 << self.depth) - 1, dtype=int), np.zeros((1 << self.depth) - 1)
        self.low, self.high = np.full((1 << self.depth, dims), -np.inf), np.full((1 << self.depth, dims), np.inf)

        def split(node: int, level: int, first: int, rows) -> None:
            if level == self.depth:
                return
            a = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) else level % dims
            c = float(np.median(rows[:, a])) if len(rows) else 0.0
            self.axis[node], self.cut[node] = a, c
            half = 1 << (self.depth - level - 1)
            self.high[first : first + half, a] = np.minimum(self.high[first : first + half, a], c)
            self.low[first + half : first + 2 * half, a] = np.maximum(self.low[first + half : first + 2 * half, a], c)
            split(2 * node + 1, level + 1, first, rows[rows[:, a] <= c])
            split(2 * node + 2, level + 1, first + half, rows[rows[:, a] > c])

        split(0, 0, 0, points)

    def of(self, points):
        import numpy as np

        node = np.zeros(len(points), dtype=int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def distance(self, point):
        """Squared projected distance from a point to each cell's bounds."""
        import numpy as np

        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Block:
    """Vectors of one block under a kd-tree of small leaves, for incremental search in order of projected distance."""

    def __init__(self, ids, vectors, dims: int, leaf: int = 64):
        import numpy as np

        self.ids, self.raw = ids, rescaled(vectors)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.points = unit(self.raw) @ directions(vectors.shape[1], dims)
        order, sizes, stack = [], [], [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            if len(rows) > leaf:
                own = self.points[rows]
                a = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                half = np.argpartition(own[:, a], len(rows) // 2)
                stack += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
            elif len(rows):
                sizes.append(len(rows))
                order.extend(rows.tolist())
        order = np.array(order, dtype=int)
        self.ids, self.raw, self.norm, self.points = self.ids[order], self.raw[order], self.norm[order], self.points[order]
        self.square = (self.points * self.points).sum(axis=1)
        self.sizes = np.array(sizes, dtype=int)
        cuts = np.split(self.points, np.cumsum(self.sizes)[:-1]) if sizes else []
        self.low = np.array([c.min(axis=0) for c in cuts]).reshape(-1, dims)
        self.high = np.array([c.max(axis=0) for c in cuts]).reshape(-1, dims)
        self.verified = 0  # how many rows were compared on their original vectors

    def search(self, own_ids, vectors, points, k: int, quantile: float, bounds, at_once: int = 128) -> list[tuple]:
        """For each query the k best (scores, ids) of this block that may be better than its bound on the k-th squared distance."""
        import numpy as np

        out = []
        for first in range(0, len(own_ids), at_once):
            some = points[first : first + at_once]
            gap = np.maximum(0, np.maximum(self.low[None] - some[:, None], some[:, None] - self.high[None]))
            reach = (gap * gap).sum(axis=2)  # from each query to each leaf
            projected = (some * some).sum(axis=1)[:, None] + self.square[None] - 2 * (some @ self.points.T)
            for i in range(len(some)):
                out.append(self._one(own_ids[first + i], vectors[first + i], reach[i], projected[i], k, quantile, bounds[first + i]))
        return out

    def _one(self, own_id, vector, reach, projected, k: int, quantile: float, kth: float):
        import numpy as np

        best_s, best_i = np.zeros(0), self.ids[:0]
        if not len(self.ids):
            return best_s, best_i
        norm = math.sqrt(float((vector * vector).sum()))
        rows = projected < quantile * kth
        if not (reach < quantile * kth).all():
            rows &= np.repeat(reach < quantile * kth, self.sizes)  # leaves that the test rules out
        rows = np.nonzero(rows & (self.ids != own_id))[0]
        order = rows[np.argsort(projected[rows], kind="stable")]
        distance = projected[order]
        at, step = 0, 8 * k
        while at < len(order) and distance[at] < quantile * kth:  # else the test holds for all that is left
            end = at + int(np.searchsorted(distance[at : at + step], quantile * kth))
            rows, at, step = order[at:end], end, step * 2
            self.verified += len(rows)
            # a sum of its own for each row, so that equal vectors have equal scores
            s = (self.raw[rows] * vector).sum(axis=1) / (self.norm[rows] * norm)
            if len(best_s) == k:
                rows, s = rows[s >= best_s[-1]], s[s >= best_s[-1]]
                if not len(rows):
                    continue
            best_s, best_i = np.concatenate([best_s, s]), np.concatenate([best_i, self.ids[rows]])
            sort = np.lexsort((best_i, -best_s))
            best_s, best_i = best_s[sort], best_i[sort]
            _, one = np.unique(best_i, return_index=True)
            one = np.sort(one)[:k]
            best_s, best_i = best_s[one], best_i[one]
            if len(best_s) == k:
                kth = min(kth, max(0.0, 2 - 2 * float(best_s[-1])) + 1e-12)
        return best_s, best_i


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>, length): the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("length", F.size("v"))


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 32, confidence: float = 0.93,
    sample: int = 8192, block_rows: int = 4096, max_cells: int = 4096, visits_per_task: int = 20_000,
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double); is_query: a condition on column `id`.

    confidence and dims trade recall for work: a true neighbour is missed with a probability of at most 1 - confidence.
    """
    quantile = chi_square_quantile(confidence, dims)
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, id_col, vec_col)
    totals = {r.length: r.n for r in valid.groupBy("length").agg(F.count("*").alias("n")).collect()}
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not totals:
        return empty
    # only lengths with more than one block of vectors are cut into cells; the sample that the driver holds is bounded over all of them
    large = {length: n for length, n in totals.items() if n > block_rows}
    trees = {}
    if large:
        import numpy as np

        each = max(512, min(sample, 8 * sample // len(large)))
        spread = F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30)) / float(1 << 30)
        rate = F.create_map(*[F.lit(x) for length, n in large.items() for x in (length, min(1.0, 0.9 * each / n))])
        picked = valid.where(spread < rate[F.col("length")]).limit(each * len(large)).collect()
        for length, n in large.items():
            rows = np.array([r.v for r in picked if r.length == length], dtype=float).reshape(-1, length)
            points = unit(rescaled(rows)) @ directions(length, dims)
            trees[length] = Cells(points, min(max_cells, -(-n // block_rows), max(1, len(rows) // 2)))
    shared = spark.sparkContext.broadcast(trees)  # at most max_cells x dims bounds for each length

    def place(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length = batch.column(2).to_numpy()
            flat, offset = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            cell = np.zeros(len(length), dtype=np.int32)
            for d in np.unique(length).tolist():
                if d not in shared.value:
                    continue  # one cell
                at = np.nonzero(length == d)[0]
                points = unit(rescaled(flat[offset[at][:, None] + np.arange(d)])) @ directions(d, dims)
                cell[at] = shared.value[d].of(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "length", "cell"])

    placed = materialize(valid.mapInArrow(place, "id long, v array<double>, length int, cell int"))
    sizes = placed.groupBy("length", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    sizes = spark.createDataFrame(sizes.collect(), "length int, cell int, parts int")  # a row a cell
    parts = {(r.length, r.cell): r.parts for r in sizes.collect()}
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(F.broadcast(sizes), ["length", "cell"]).select("length", "cell", part, "id", "v")
    block = ["length", "cell", "part"]

    def found(key, data, queries, with_vector: bool):
        import numpy as np
        import pandas as pd

        names = ["query_id", "v", "length", "cell", "part", "kth", "ids", "scores"]
        rows = []
        if len(queries):
            d = int(key[0])
            vectors_ = np.stack(data["v"].to_numpy()) if len(data) else np.zeros((0, d))
            held = Block(data["id"].to_numpy(), vectors_.astype(float), dims)
            asked = rescaled(np.stack(queries["v"].to_numpy()).astype(float))
            points = unit(asked) @ directions(d, dims)
            own, bounds = queries["id"].tolist(), queries["kth"].tolist()
            best = held.search(own, asked, points, k, quantile, bounds)
            for i, (q, kth, (s, ids)) in enumerate(zip(own, bounds, best, strict=True)):
                now = max(0.0, 2 - 2 * float(s[-1])) + 1e-12 if len(s) == k else math.inf
                rows.append((q, queries["v"].iloc[i] if with_vector else None, d, key[1], key[2], min(kth, now), ids.tolist(), s.tolist()))
        return pd.DataFrame(rows, columns=names)

    kind = "query_id long, v array<double>, length int, cell int, part int, kth double, ids array<long>, scores array<double>"
    asked = dealt.where(is_query).select(*[F.col(c).alias(c) for c in dealt.columns], F.lit(float("inf")).alias("kth"))
    first = dealt.groupBy(*block).cogroup(asked.groupBy(*block)).applyInPandas(lambda key, data, queries: found(key, data, queries, True), kind)
    first = materialize(first)

    def visit(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for r in batch.to_pylist():
                d = r["length"]
                point = (unit(rescaled(np.array([r["v"]]))) @ directions(d, dims))[0]
                near = np.nonzero(shared.value[d].distance(point) < quantile * r["kth"])[0].tolist() if d in shared.value else [0]
                for c in near:
                    for p in range(parts.get((d, c), 0)):
                        if (c, p) != (r["cell"], r["part"]):
                            for column, x in zip(out, (r["query_id"], r["v"], d, c, p, r["kth"]), strict=True):
                                column.append(x)
            types = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["id", "v", "length", "cell", "part", "kth"])

    visits = materialize(first.select("query_id", "v", "length", "cell", "part", "kth").mapInArrow(visit, "id long, v array<double>, length int, cell int, part int, kth double"))
    tasks = visits.groupBy(*block).agg(F.ceil(F.count("*") / visits_per_task).cast("int").alias("slices"))
    tasks = materialize(tasks)
    by = [*block, "slice"]
    twice = dealt.join(tasks, block).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*by, "id", "v")
    sliced = visits.join(tasks, block).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    sliced = sliced.select(*[F.col(c).alias(c) for c in (*by, "id", "v", "kth")])  # names of its own for both sides of the cogroup
    second = twice.groupBy(*by).cogroup(sliced.groupBy(*by)).applyInPandas(lambda key, data, queries: found(key, data, queries, False), kind)
    both = first.select("query_id", "ids", "scores").unionByName(second.select("query_id", "ids", "scores"))
    pairs = both.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).groupBy("query_id", F.col("p.ids").alias("vec_id")).agg(F.max("p.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
