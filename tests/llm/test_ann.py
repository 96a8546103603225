import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k=5):
    out = {}
    live = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        live.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    for q in queries:
        if q not in live:
            continue
        best = {}
        for a in live[q]:
            for i, vs in live.items():
                for b in vs:
                    if i != q and len(a) == len(b):
                        best[i] = max(best.get(i, -2), float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)))
        out[q] = sorted(best, key=lambda i: (-round(best[i], 12), i))[:k]
    return out


def searched(df, **options):
    got = {}
    for r in sorted(ann.search(df, F.col("id") % 10 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.get(r.query_id, [])) + 1
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.001
    assert abs(ann.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
    with pytest.raises(ValueError):
        ann.chi_square_quantile(0.5, 3)


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_recall_with_a_frequent_vector(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0] * 16) for i in range(250)]  # one vector, very often
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want, got = brute(rows, range(0, 850, 10)), searched(df, block_rows=block_rows, max_cells=16)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[600] == [601, 602, 603, 604, 605]  # ties by id


def test_recall_and_verified_share_on_the_given_vectors():
    """The stopping test must both find neighbours and spare most vectors, for vectors that hold little structure."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = np.array(t.column("vec_id").to_pylist()), np.array(t.column("embedding").to_pylist(), dtype=float)
    block = ann.Block(ids, x, 32)
    asked = np.nonzero(ids % 10 == 0)[0]
    q = ann.rescaled(x[asked])
    points = ann.unit(q) @ ann.directions(x.shape[1], 32)
    found = block.search(ids[asked].tolist(), q, points, 5, ann.chi_square_quantile(0.93, 32), [math.inf] * len(asked))
    cosine = ann.unit(x[asked]) @ ann.unit(x).T
    cosine[np.arange(len(asked)), asked] = -2
    true = [set(ids[np.argsort(-row)[:5]].tolist()) for row in cosine]
    recall = np.mean([len(a & set(got.tolist())) / 5 for a, (_, got) in zip(true, found, strict=True)])
    share = block.verified / len(asked) / len(ids)
    print(f"recall {recall:.3f}, verified {share:.3f}")
    assert recall >= 0.92 and share <= 0.45


def test_many_lengths(spark):
    rows = [(i * 10 + j, [1.0, float(j)] + [0.5] * i) for i in range(300) for j in range(3)]
    got = searched(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert len(got) == 300 and all(v == [q + 1, q + 2] for q, v in got.items())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (1, [1.0, 0.1]), (9, [-1.0, 0.0]), (10, [1e-30, 2e-30]), (20, [0.0, 0.0, 5.0])]
    got = searched(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert got == {0: [1, 10, 9], 10: [1, 0, 9], 20: [8]}


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).count() == 0
