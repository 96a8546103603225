import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from quiverlake.functions import labels as L
from quiverlake.functions import predicate as P
from quiverlake.operators import access, algorithms, compaction, delta, traverse
from quiverlake.operators.traverse import Direction, Projection
from quiverlake.plans.info import AdjList, EdgeInfo, Property, PropertyGroup, VertexInfo
from quiverlake.plans.types import LABELS
from quiverlake.session import checksum
from quiverlake.sinks.writers import EdgeWriter, VertexWriter
from quiverlake.sources.importers import ImportConfig, read_edge_list, run_import
from quiverlake.sources.readers import EdgeReader, VertexReader


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(3, 3), (5, 6), (5, 6), (70, 71), (71, 72)]
    return pairs, edges(spark, pairs).cache()


def near(pairs, direction):
    out = {}
    for a, b in pairs:
        if direction != "incoming":
            out.setdefault(a, []).append(b)
        if direction != "outgoing":
            out.setdefault(b, []).append(a)
    return {k: sorted(v) for k, v in out.items()}


def test_null_logic(spark):
    df = spark.createDataFrame([(i, x, s, d) for i, (x, s, d) in enumerate([(1, "a", 0.5), (7, "b", None), (None, "c", 1.0), (9, None, 2.0)])], "vid long, n int, s string, d double")
    n, s = P.prop("n"), P.prop("s")

    def ids(e, nulls="two"):
        return [r.vid for r in P.matching_ids(df, e, nulls=nulls).collect()]

    assert ids(P.eq(n, 7)) == [1] and ids(~P.eq(n, 7)) == [0, 2, 3] and ids(P.ne(n, 7)) == [0, 3] and ids(~P.ne(n, 7)) == [1, 2]
    assert ids(~P.lt(n, 8)) == [2, 3] and ids(~P.ge(n, 8)) == [0, 1, 2]
    assert ids(~(P.eq(n, 7) & P.eq(s, "b"))) == [0, 2, 3] and ids(~(P.eq(n, 7) | P.eq(s, "a"))) == [2, 3]
    assert ids(~P.lt(n, 8), "three") == [3] and ids(~(P.eq(n, 7) & P.eq(s, "b")), "three") == [0, 2, 3]
    assert ids(~P.eq(n, 7), "three") == [0, 3]
    assert ids(P.is_null("n")) == [2] and ids(P.not_null("n")) == [0, 1, 3] and ids(~~P.eq(n, 7)) == [1]
    assert ids(P.gt(8, n)) == [0, 1] and ids(P.lt(8, n)) == [3]
    assert P.And((P.eq(n, 1), P.And((P.eq(n, 2), P.eq(n, 3))))).parts == (P.eq(n, 1), P.eq(n, 2), P.eq(n, 3))
    for bad in (P.eq(n, "x"), P.eq(n, 1.0), P.eq(n, True), P.eq(n, 1 << 40), P.eq(P.prop("d"), 1), P.eq(n, s)):
        with pytest.raises(TypeError):
            P.compile_filter(bad, df.schema)
    with pytest.raises(ValueError):
        P.compile_filter(P.eq(P.prop("d"), float("nan")), df.schema)
    with pytest.raises(KeyError):
        P.compile_filter(P.eq(P.prop("N"), 1), df.schema)
    with pytest.raises(KeyError):
        P.check_group(P.eq(P.prop("zz"), 1), PropertyGroup((Property("n", "int32"),)))
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.date(2024, 1, 1))], "t timestamp, d date")
    assert P.filter_rows(t, P.eq(P.prop("d"), dt.date(2024, 1, 1)) & P.le(P.prop("t"), dt.datetime(2024, 1, 1))).count() == 1
    with pytest.raises(ValueError):
        P.compile_filter(P.eq(P.prop("t"), dt.datetime(2024, 1, 1, microsecond=5)), t.schema)


def test_random_filters_against_python(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *range(5)]), rng.choice([None, *range(5)])) for i in range(200)]
    df = spark.createDataFrame(rows, "vid long, a int, b int")

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            name, k = rng.choice("ab"), rng.randrange(5)
            op = rng.choice(["=", "!=", "<", "<=", ">", ">="])
            test = {"=": lambda x: x == k, "!=": lambda x: x != k, "<": lambda x: x < k, "<=": lambda x: x <= k, ">": lambda x: x > k, ">=": lambda x: x >= k}[op]
            at = 1 + "ab".index(name)
            return P.Compare(op, P.prop(name), P.Literal(k)), lambda r: r[at] is not None and test(r[at])
        kind = rng.choice(["and", "or", "not", "null"])
        if kind == "null":
            return P.is_null("a"), lambda r: r[1] is None
        if kind == "not":
            e, f = make(depth - 1)
            return P.Not(e), lambda r: not f(r)
        (e, f), (g, h) = make(depth - 1), make(depth - 1)
        return (e & g, lambda r: f(r) and h(r)) if kind == "and" else (e | g, lambda r: f(r) or h(r))

    for _ in range(40):
        e, f = make(4)
        assert [r.vid for r in P.filter_rows(df, e).orderBy("vid").collect()] == [r[0] for r in rows if f(r)]


def test_labels(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, []), (3, None), (40000, ["a"])], f"vid long, `{LABELS}` array<string>")
    wide = L.label_columns(df, ["a", "b"])
    assert [r.vid for r in L.with_labels(wide, ["a", "b"]).collect()] == [0]
    assert [r.vid for r in L.with_labels(wide, ["a", "b"], any_of=True).collect()] == [0, 1, 40000]
    assert L.label_query(wide, ["a"], "count").first().n == 2
    bits = {r.bucket: bytes(r.bitmap) for r in L.label_query(wide, ["a"], "bitmap").collect()}
    ids = sorted(32768 * (b - 1) + 8 * k + j for b, m in bits.items() for k, byte in enumerate(m) for j in range(8) if byte >> j & 1)
    assert ids == [0, 40000]
    assert L.has_label(df, 1, "b").first().has_label and L.labels_of(df, 0).first()[LABELS] == ["a", "b"]
    with pytest.raises(KeyError):
        L.with_labels(wide, ["c"])
    within = spark.createDataFrame([(1,), (0,)], "vid long")
    assert [r.vid for r in L.with_labels(wide, ["b"], within=within).collect()] == [0, 1]


def test_access(spark, web):
    pairs, e = web
    out = near(pairs, "outgoing")
    assert [r.dst for r in access.neighbors(e, 5).collect()] == out[5]
    assert [r.dst for r in access.neighbors(e, 5, 2).collect()] == out[5][:2]
    ids = spark.createDataFrame([(5,), (5,), (99,)], "vid long")
    assert {r.vid: r.neighbors for r in access.batched_neighbors(e, ids).collect()} == {5: out[5], 99: []}
    assert sorted(r.neighbor for r in access.neighbor_pairs(e, ids).collect()) == out[5]
    v = spark.range(73).withColumnRenamed("id", "vid")
    assert {r.vid: r.degree for r in access.degrees(v, e).collect()} == {i: len(out.get(i, [])) for i in range(73)}
    assert access.neighbor_at(e, 5, 1) == out[5][1]
    for k in (-1, 999):
        with pytest.raises(IndexError):
            access.neighbor_at(e, 5, k)
    assert {r.vid: r.neighbor for r in access.kth_neighbor(e, 1).collect()} == {i: n[1] for i, n in out.items() if len(n) > 1}
    placed = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(sorted(pairs))], "eid long, src long, dst long")
    want = min(k for k, p in enumerate(sorted(pairs)) if p[1] == 6)
    assert access.first_edge(placed, 6, "dst").first().eid == want and access.first_edge(placed, 6, "dst", want + 1).first().eid > want
    assert {r.vid: r.eid for r in access.first_edges(placed, "dst").collect()}[6] == want
    assert access.find(v, 7).count() == 1 and access.edges_of(e, 5, "dst").count() == len(near(pairs, "incoming")[5])


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "undirected"])
def test_projection(spark, web, direction):
    pairs, e = web
    p = traverse.materialize_csr(e, 73, direction)
    assert {r.vid: r.neighbors for r in p.csr().collect()} == {i: near(pairs, direction).get(i, []) for i in range(73)}
    more = p.merge(edges(spark, [(1, 2), (72, 72)]))
    assert {r.vid: r.neighbors for r in more.csr().collect()} == {i: near([*pairs, (1, 2), (72, 72)], direction).get(i, []) for i in range(73)}
    with pytest.raises(ValueError):
        p.merge(edges(spark, [(1, 73)]))


def test_projection_bounds(web):
    _, e = web
    with pytest.raises(traverse.CapacityError):
        traverse.materialize_csr(e, 73, max_vertices=72)
    with pytest.raises(traverse.CapacityError):
        traverse.materialize_csr(e, 73, max_edges=3)
    with pytest.raises(ValueError):
        traverse.materialize_csr(e, 73, "incoming", same_type=False)


def visit(out, start, depth, budget):
    """Level by level in order of discovery, cut by the budget."""
    seen, level, truncated = {start: 0}, [start], False
    for d in range(1, depth + 1):
        new = []
        for v in sorted(level):
            for w in out.get(v, []):
                if w not in seen and not truncated:
                    if len(seen) == budget:
                        truncated = True
                    else:
                        seen[w] = d
                        new.append(w)
        if truncated or not new:
            break
        level = new
    return seen, truncated


def test_bounded_traversal(spark, web):
    pairs, e = web
    p = traverse.materialize_csr(e, 73, "undirected")
    out = near(pairs, "undirected")
    for start, depth, budget in [(0, 2, 1000), (0, 9, 12), (5, 3, 1), (5, 0, 9), (70, 9, 9), (72, 9, 2), (72, 9, 3), (1, 2, 7)]:
        got = traverse.neighborhood(p, start, depth, budget)
        seen, truncated = visit(out, start, depth, min(budget, 73))
        assert {r.vid: r.depth for r in got.rows.collect()} == seen and (got.truncated, got.size) == (truncated, len(seen))
    whole = traverse.component(p, 72, 100)
    assert whole.component_id() == 70 and [r.vid for r in whole.ordered().collect()] == [72, 71, 70] and traverse.component(p, 72, 2).component_id() is None
    for bad in ((73, 1, 1), (0, -1, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            traverse.neighborhood(p, *bad)
    fronts = [sorted(r.vid for r in f.collect()) for f in traverse.walk_frontiers(p, 72, 3)]
    assert fronts == [[72], [71], [70, 72], [71]]
    pairs_ = spark.createDataFrame([(70, 72), (72, 70), (70, 70), (70, 0), (70, 72)], "a long, b long")
    assert {(r.a, r.b): r.hops for r in traverse.hops_between(p, pairs_, 2).collect()} == {(70, 72): 2, (72, 70): 2, (70, 70): 0, (70, 0): -1}
    assert {r.hops for r in traverse.hops_between(p, pairs_.where("a = 70 AND b = 72"), 1).collect()} == {-1}


def test_algorithms(spark, web):
    pairs, e = web
    n = 73
    out = near(pairs, "outgoing")
    rank = [1 / n] * n
    for _ in range(10):
        new = [0.0] * n
        for a, b in pairs:
            new[b] += rank[a] / len(out[a])
        rank = [0.85 * x + 0.15 / n + (0.85 * rank[i] if i not in out else 0) for i, x in enumerate(new)]
    got = {r.vid: r["rank"] for r in algorithms.pagerank(e, n).collect()}
    assert all(got[i] == pytest.approx(rank[i]) for i in range(n))
    both = near(pairs, "undirected")
    comp = {}
    for i in range(n):
        if i not in comp:
            for v in visit(both, i, 10**6, 10**6)[0]:
                comp[v] = i
    cc = algorithms.connected_components(e, n)
    assert {r.vid: r.component for r in cc.collect()} == comp
    assert algorithms.component_count(cc).first().n == len(set(comp.values()))
    p = Projection(traverse.directed(e, "outgoing"), n)
    seen = visit(out, 5, 10**6, 10**6)[0]
    assert {r.vid: r.distance for r in algorithms.bfs(p, 5).collect()} == {i: seen.get(i, -1) for i in range(n)}
    parents = {r.vid: r.parent for r in algorithms.bfs_parents(p, 5).collect()}
    want = {i: -1 if i not in seen else 5 if i == 5 else min(a for a, b in pairs if b == i and seen.get(a) == seen[i] - 1) for i in range(n)}
    assert parents == want


def test_long_path_components(spark):
    chain = edges(spark, [(i, i + 1) for i in range(400)])
    assert {r.component for r in algorithms.connected_components(chain, 401).collect()} == {0}


def test_heterogeneous(spark):
    ids = lambda names: spark.createDataFrame([(x, i) for i, x in enumerate(names)], "id string, vid long")
    h = traverse.Heterogeneous("outgoing").add_vertex_type("user", ids("abc")).add_vertex_type("device", ids("xy")).add_edge_type("user", "owns", "device", edges(spark, [(0, 1), (2, 0)]))
    assert h.bases == [("user", 0, 3), ("device", 3, 2)]
    assert sorted(tuple(r) for r in h.build().edges.collect()) == [(0, 4), (2, 3)]
    assert {(r.type, r.id): r.gid for r in h.global_index().collect()} == {("user", "a"): 0, ("user", "b"): 1, ("user", "c"): 2, ("device", "x"): 3, ("device", "y"): 4}
    with pytest.raises(KeyError):
        h.add_edge_type("user", "at", "place", edges(spark, []))
    with pytest.raises(ValueError):
        h.add_vertex_type("user", ids("a"))
    new_v = spark.createDataFrame([("user", "d"), ("user", "a"), ("device", "w")], "type string, id string")
    new_e = spark.createDataFrame([("user", "d", "owns", "device", "w")], "src_type string, src_id string, edge string, dst_type string, dst_id string")
    grown = h.merge(new_v, new_e)
    assert grown.bases == [("user", 0, 4), ("device", 4, 3)] and sorted(tuple(r) for r in grown.build().edges.collect()) == [(0, 5), (2, 4), (3, 6)]
    with pytest.raises(KeyError):
        h.merge(new_v.limit(0), new_e)
    places = access.place_of(spark.createDataFrame([(4,), (0,), (9,)], "gid long"), h.bases)
    assert {r.gid: (r.type, r.local) for r in places.collect()} == {4: ("device", 1), 0: ("user", 0), 9: (None, None)}


def test_served_projection_and_snapshot(spark, tmp_path, web):
    _, e = web
    built = []

    def build():
        built.append(1)
        return Projection(traverse.directed(e, "outgoing"), 73)

    s = traverse.ServedProjection(build)
    assert s.current()[1] == 1 and s.refresh() == 2 and not s.refresh_if_stale(1000) and s.refresh_if_stale(-1) and len(built) == 3
    assert s.merge(edges(spark, [(1, 2)])) == 4 and s.current()[0].edges.count() == e.count() + 1
    assert s.rewrite_dataset(lambda: built.append(1)) == 5
    path = f"file://{tmp_path}/snap"
    traverse.write_snapshot(s.current()[0], path)
    back = traverse.read_snapshot(spark, path)
    assert (back.count, back.direction) == (73, Direction.OUTGOING) and back.edges.exceptAll(s.current()[0].edges).count() == 0
    spark.createDataFrame([(1, 2)], "src long, dst long").write.mode("append").parquet(path + "/edges")
    with pytest.raises(ValueError):
        traverse.read_snapshot(spark, path)
    traverse.write_snapshot(back, f"{path}2")
    rows = [tuple(r) for r in back.edges.collect()]
    edges(spark, [(rows[0][0], rows[0][1] + 1), *rows[1:]]).write.mode("overwrite").parquet(f"{path}2/edges")  # as many, one of them another
    with pytest.raises(ValueError, match="corrupt"):
        traverse.read_snapshot(spark, f"{path}2")
    (tmp_path / "snap2" / "header.json").unlink()
    with pytest.raises(ValueError, match="never finished"):
        traverse.read_snapshot(spark, f"{path}2")


def test_checksum_of_rows(spark):
    rows = [(1, 2), (1, 2), (3, 4), (None, 5)]
    one = checksum(edges(spark, rows).repartition(3))
    assert one == checksum(edges(spark, rows[::-1]).coalesce(1)) and one["rows"] == 4
    assert one != checksum(edges(spark, [(3, 4), (3, 4), (3, 4), (None, 5)]))  # repeated rows don't cancel out
    assert checksum(edges(spark, rows).limit(0)) == {"rows": 0, "xor": 0, "sum": 0}


def test_delta_recovers_from_damage(spark, tmp_path):
    base, path = Projection(edges(spark, [(0, 1)]), 10), f"file://{tmp_path}/delta"
    d = delta.MutableDelta(spark, path, base)
    for batch in ([(1, 2), (2, 3)], [(3, 4)], [(4, 5), (5, 6)]):
        d.append_all(edges(spark, batch))
    last = tmp_path / "delta" / "batch-3-5"
    part = next(last.glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:20])  # a torn tail
    back = delta.MutableDelta.recover(spark, path, base)
    assert back.next == back.sealed == 3 and sorted((r.src, r.dst) for r in back.edges().collect()) == [(1, 2), (2, 3), (3, 4)]
    assert not last.exists() and len(list((tmp_path / "delta").glob(".torn-3-5-*"))) == 1
    assert back.append(7, 8) == 3 and delta.MutableDelta.recover(spark, path, base).next == 4
    (tmp_path / "delta" / "header.json").rename(tmp_path / "delta" / ".header.tmp")  # a crash while the header was replaced
    back = delta.MutableDelta.recover(spark, path, base)
    back.rebase(Projection(edges(spark, [(0, 1), (1, 2), (2, 3)]), 10), 2)
    (tmp_path / "delta" / "header.json").rename(tmp_path / "delta" / ".header.tmp")
    assert delta.MutableDelta.recover(spark, path, back.base).floor == 2
    (tmp_path / "delta" / "batch-2-3" / "_checksum.json").unlink()
    with pytest.raises(ValueError, match="damaged"):
        delta.MutableDelta.recover(spark, path, back.base)
    shutil.rmtree(tmp_path / "delta" / "batch-2-3")
    with pytest.raises(ValueError, match="missing"):
        delta.MutableDelta.recover(spark, path, back.base)


INFO = EdgeInfo("p", "k", "p", 13, 10, 10, True, (AdjList("ordered_by_source"), AdjList("unordered_by_dest")), (PropertyGroup((Property("w", "double"),)),))


def test_arrivals(spark):
    df = edges(spark, [(5, 5), (5, 6), (4, 9), (6, 0), (25, 1)])
    got = delta.classify(df, INFO, "ordered_by_source", (5, 6))
    assert {(r.src, r.dst): r.arrival_class for r in got.collect()} == {(5, 5): "PATCH", (5, 6): "APPEND_TAIL", (4, 9): "PATCH", (6, 0): "APPEND_TAIL", (25, 1): "APPEND_TAIL"}
    assert [r.vertex_chunk for r in delta.patched_chunks(got).collect()] == [0]
    assert delta.frontier_of(df, INFO, "ordered_by_source") == (25, 1) and delta.frontier_of(df.limit(0), INFO, "ordered_by_source") is None
    assert {r.arrival_class for r in delta.classify(df, INFO, "ordered_by_source", None).collect()} == {"APPEND_TAIL"}
    with pytest.raises(ValueError):
        delta.ordering_of(INFO, "unordered_by_dest")


def test_delta_view_is_the_rebuilt_graph(spark, tmp_path, web):
    pairs, e = web
    base = Projection(traverse.directed(edges(spark, pairs[:60]), "undirected"), 73, Direction.UNDIRECTED)
    path = f"file://{tmp_path}/delta"
    d = delta.MutableDelta(spark, path, base, capacity=40)
    assert d.append_all(edges(spark, pairs[60:80])) == (0, 20)
    assert d.view().projection.edges.count() == 120  # not sealed
    first = d.seal()
    d.append_all(edges(spark, pairs[80:]))
    d.append(72, 0)
    d.seal()
    assert d.view(first).projection.edges.count() == 160
    want = near([*pairs, (72, 0)], "undirected")
    view = d.view()
    assert {r.vid: r.neighbors for r in view.projection.csr().collect()} == {i: want.get(i, []) for i in range(73)}
    assert [r.dst for r in view.neighbors(0).collect()] == want[0] and view.degree(0).first().degree == len(want[0])
    assert {r.vid: r.depth for r in view.neighborhood(72, 3, 20).rows.collect()} == visit(want, 72, 3, 20)[0]
    with pytest.raises(traverse.CapacityError):
        d.append_all(edges(spark, [(0, 1)] * 30))
    with pytest.raises(ValueError):
        d.append(0, 73)
    new = d.add_vertices(2)
    assert list(new) == [73, 74] and d.append(74, 0) == 36
    spark.createDataFrame([(1, 2, 3)], "seq long, src long, dst long").write.parquet(path + "/.staging-torn")
    back = delta.MutableDelta.recover(spark, path, base)
    assert back.next == 37 and back.vertices == 75 and back.edges().count() == 37
    with pytest.raises(ValueError):
        delta.MutableDelta(spark, path, Projection(base.edges, 5))
    grown = Projection(base.edges.unionByName(traverse.directed(edges(spark, pairs[60:80]), "undirected")), 73, Direction.UNDIRECTED)
    before = {r.vid: r.neighbors for r in back.view().projection.csr().collect()}
    back.rebase(grown, 20)
    assert {r.vid: r.neighbors for r in back.view().projection.csr().collect()} == before and back.edges().count() == 17
    known = spark.createDataFrame([("a", 0)], "id string, vid long")
    ids = {r.id: r.vid for r in back.vertex_ids(known, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert ids == {"a": 0, "b": 1}


def test_compaction(spark, tmp_path):
    prefix = f"file://{tmp_path}/"
    rows = [(i % 25, i * 7 % 25, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "src long, dst long, w double")
    EdgeWriter(prefix, INFO, "ordered_by_source", 25, df).write_edges()
    patches = spark.createDataFrame([(0, 3, 3, 0.5), (1, 12, 1, 0.5), (2, 4, 4, 0.5), (9, 5, 5, 0.5)], "seq long, src long, dst long, w double")
    s = compaction.compact_chunk(prefix, INFO, "ordered_by_source", 0, patches, 5).first()
    assert (s.base_edges, s.patch_edges, s.total_edges, s.edge_chunks, s.watermark) == (40, 2, 42, 4, 5)
    r = EdgeReader(prefix, INFO, "ordered_by_source", spark)
    got = sorted((x.src, x.dst, x.w) for x in r.read_edges(False).collect())
    assert got == sorted([*rows, (3, 3, 0.5), (4, 4, 0.5)]) and r.read_edges_number() == 102
    assert sorted(x.seq for x in compaction.remaining(patches, INFO, "ordered_by_source", 0, 5).collect()) == [1, 9]
    none = compaction.compact_chunk(prefix, INFO, "ordered_by_source", 2, patches, 5).first()
    assert (none.patch_edges, none.total_edges) == (0, 20)
    with pytest.raises(ValueError):
        compaction.compact_chunk(prefix, INFO, "unordered_by_dest", 0, patches, 5)


def test_read_penalty(spark):
    profile = spark.createDataFrame([(0, 3.0), (1, 1.0)], "vid long, weight double")
    degrees = spark.createDataFrame([(0, 2), (1, 6)], "vid long, degree long")
    r = delta.read_penalty(profile, degrees, edges(spark, [(0, 1), (0, 2)])).first()
    assert (r.probability_of_patched_read, r.expected_extra_entries, r.expected_base_entries, r.read_amplification) == (0.75, 1.5, 3.0, 1.5)
    zero = degrees.withColumn("degree", F.lit(0))
    assert delta.read_penalty(profile, zero, edges(spark, [])).first().read_amplification == 1.0
    assert delta.read_penalty(profile, zero, edges(spark, [(0, 1)])).first().read_amplification == float("inf")


def test_write_back(spark, tmp_path):
    v = VertexInfo("p", 10, (PropertyGroup((Property("id", "int64", True),)),))
    prefix = f"file://{tmp_path}/"
    VertexWriter(prefix, v, spark.range(25).select(F.col("id").alias("vid"), "id")).write()
    grown = algorithms.write_back(prefix, v, spark.range(25).select(F.col("id").alias("vid"), (F.col("id") / 2).alias("rank")), "rank", "double")
    assert {r.id: r["rank"] for r in VertexReader(prefix, grown, spark).read_all_vertex_property_groups().collect()} == {i: i / 2 for i in range(25)}


CONFIG = """
output:
  path: {path}/out
  name: shop
  vertex_chunk_size: 10
  edge_chunk_size: 20
import_schema:
  vertices:
    - type: person
      property_groups:
        - properties:
            - {{name: id, data_type: int64, is_primary: true}}
            - {{name: age, data_type: int32}}
      sources:
        - {{path: "{path}/a.csv", delimiter: "|", columns: {{ID: id, years: age}}}}
        - {{path: "{path}/b.json", columns: {{ident: id, age: age}}}}
  edges:
    - src_type: person
      edge_type: knows
      dst_type: person
      src_prop: id
      dst_prop: id
      property_groups:
        - properties: [{{name: since, data_type: date}}]
      sources:
        - {{path: "{path}/k.csv", columns: {{a: src, b: dst, day: since}}}}
"""


def test_import(spark, tmp_path):
    from quiverlake.cli import main

    (tmp_path / "a.csv").write_text("ID|years|x\n1|20|q\n2||q\n")
    (tmp_path / "b.json").write_text('{"ident": 7, "age": 30}\n')
    (tmp_path / "k.csv").write_text("a,b,day\n1,7,2020-01-02\n7,1,2021-01-02\n2,7,\n")
    text = CONFIG.format(path=f"file://{tmp_path}")
    info = run_import(spark, ImportConfig.parse(text))
    v = VertexReader(info.prefix, info.vertex("person"), spark).read_all_vertex_property_groups()
    assert sorted((r.vid, r.id, r.age) for r in v.collect()) == [(0, 1, 20), (1, 2, None), (2, 7, 30)]
    e = EdgeReader(info.prefix, info.edges[0], "ordered_by_source", spark).read_edges()
    assert [(r.src, r.dst, str(r.since)) for r in e.orderBy("eid").collect()] == [(0, 2, "2020-01-02"), (1, 2, "None"), (2, 0, "2021-01-02")]
    path = f"{info.prefix}shop.graph.yml"
    assert main(["check", "-p", path]) == 0 and main(["validate", "-p", path, "--strict"]) == 0 and main(["show", "-p", path, "-v", "person"]) == 0
    (tmp_path / "k.csv").write_text("a,b,day\n1,99,2020-01-02\n")
    with pytest.raises(ValueError):
        run_import(spark, ImportConfig.parse(text))
    bad = text.replace("is_primary: true", "is_primary: false").replace('delimiter: "|"', 'delimiter: "||"').replace("years: age", "years: id")
    found = " ".join(ImportConfig.parse(bad).issues())
    assert "primary key" in found and "delimiter" in found and "one name" in found and "doesn't give" in found


def test_connectors(spark, tmp_path):
    from quiverlake.sinks.export import export_edges, export_vertices
    from quiverlake.sources.importers import Source, read_source

    v = spark.createDataFrame([(0, "a"), (1, "b")], "vid long, key string")
    export_vertices(v, "json", {"path": f"file://{tmp_path}/v"}, tasks=1)
    export_edges(edges(spark, [(0, 1), (1, 1)]), v, v, "json", path=f"file://{tmp_path}/e")
    source = Source("", {"src_key": "src", "dst_key": "dst"}, format="json", options={"path": f"file://{tmp_path}/e"})
    assert source.issues() == [] and sorted(tuple(r) for r in read_source(spark, source).collect()) == [("a", "b"), ("b", "b")]
    assert [c for c in read_source(spark, Source(f"file://{tmp_path}/v", {"key": "id"}, format="json")).columns] == ["id"]
    (tmp_path / "k.csv").write_text("a,b,day\n1,7,2020-01-02\n")
    text = CONFIG.format(path=f"file://{tmp_path}")
    config = ImportConfig.parse(text)
    config.vertices[0]["sources"] = [{"format": "range", "options": {"start": 1, "end": 8}, "columns": {"id": "id"}}]
    assert [s.name for s in config._sources(config.vertices[0])] == ["range"]
    with pytest.raises(ValueError, match="json lacks"):
        read_source(spark, Source("", {"nothing": "x"}, format="json", options={"path": f"file://{tmp_path}/e"}))


def test_edge_list(spark, tmp_path):
    (tmp_path / "snap.txt").write_text("# comment\n1 2\n  # more\n\n3\t4\n")
    assert [tuple(r) for r in read_edge_list(spark, f"file://{tmp_path}/snap.txt").orderBy("src").collect()] == [(1, 2), (3, 4)]


def test_stream_of_arrivals(spark, tmp_path):
    from quiverlake.streaming.arrivals import append_stream, arrivals_by_window, classified_stream

    source = f"file://{tmp_path}/in"
    schema = "src long, dst long, at timestamp"
    rows = [(1, 2, dt.datetime(2024, 1, 1, 0, 5)), (9, 1, dt.datetime(2024, 1, 1, 1, 5)), (1, 2, dt.datetime(2024, 1, 1, 0, 6))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    base = Projection(edges(spark, [(5, 5)]), 20)
    d = delta.MutableDelta(spark, f"file://{tmp_path}/delta", base)
    for _ in range(2):  # the second run finds nothing new
        append_stream(spark.readStream.schema(schema).parquet(source), d, f"file://{tmp_path}/ck").awaitTermination()
    assert sorted((r.src, r.dst) for r in d.edges().collect()) == [(1, 2), (1, 2), (9, 1)]
    stream = arrivals_by_window(classified_stream(spark.readStream.schema(schema).parquet(source), INFO, "ordered_by_source", (5, 5)), "at")
    stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.arrival_class, r.n) for r in spark.table("windows").collect()) == [("APPEND_TAIL", 1), ("PATCH", 2)]
