import pytest

from quiverlake.llm import mixing as M


def water(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while True:
        share = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * share >= most * sizes[s]]
        if not over:
            return target | {s: w[s] * share for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)


def rows_of(spark):
    rows = []
    for i in range(900):
        rows.append((i, "w " * (1 + i % 13), ["a", "b", "c", None, "é"][0 if i % 3 == 0 else i % 5], "x"))
    return rows + [(1000, None, "a", "x"), (1001, "", "empty", "x"), (None, "one two", "b", "x"), (None, "one two", "b", "x"), (5, "same id", "a", "x"), (1002, "big " * 5000, "big", "x")]


def test_targets_and_taken(spark):
    data = rows_of(spark)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, taken string")
    rows = M.mix(df).collect()
    assert len(rows) == len(data)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(15, 5000 if s == "big" else 0)
    again = M.mix(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_apply_keeps_rows(spark):
    df = spark.createDataFrame(rows_of(spark), "doc_id long, text string, source string, taken string")
    out = M.apply_mix(df)
    assert set(df.columns) < set(out.columns) and len(out.columns) == len(df.columns) + 2
    want = sorted((str(r.id), r.source or "", r.copies, r.taken) for r in M.mix(df).collect() if r.copies)
    assert sorted((str(r.doc_id), r.source or "", r.copies, r.taken_) for r in out.collect()) == want


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    rows = M.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_sql(spark, small):
    import duckdb

    from quiverlake.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op5_mixing"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in queries.op5_mixing(spark, small).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)
