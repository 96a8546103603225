import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from quiverlake.operators.validate import CODES, DatasetValidator
from quiverlake.operators.index import DuplicateKey, IndexGenerator, MissingEnd, dense_ids
from quiverlake.operators.transform import GraphTransformer
from quiverlake.plans import paths
from quiverlake.plans.info import AdjList, EdgeInfo, GraphInfo, Property, PropertyGroup, VertexInfo
from quiverlake.plans.types import LABELS, AdjListType, FileType, Reserved
from quiverlake.session import Store
from quiverlake.sinks.chunks import write_chunks
from quiverlake.sinks.writers import EdgesBuilder, EdgeWriter, GraphWriter, ValidateLevel, VertexWriter, VerticesBuilder, WriteMode, finish_rewrites, rewrite_edge_partition
from quiverlake.sources.control import read_value, write_value
from quiverlake.sources.readers import EdgeReader, GraphReader, VertexReader


def graph(kind="parquet", prefix="", labels=("x", "y"), size=7, edge_size=13):
    v = VertexInfo("p", size, (PropertyGroup((Property("id", "int64", True),), kind), PropertyGroup((Property("name", "string"), Property("day", "date")), kind)), labels)
    e = EdgeInfo("p", "k", "p", edge_size, size, size, True, tuple(AdjList(x, kind) for x in AdjListType), (PropertyGroup((Property("w", "double"),), kind), PropertyGroup((Property("t", "string"), Property("n", "int32")), kind)))
    return GraphInfo("g", (v,), (e,), prefix)


def frames(spark, n=45, m=200):
    rows = [(i * 3, None if i % 5 == 0 else f"n{i}, \"q\"", dt.date(2020, 1, 1 + i % 28), (["x"] if i % 2 else []) + (["y"] if i % 3 == 0 else [])) for i in range(n)]
    v = spark.createDataFrame(rows, f"id long, name string, day date, `{LABELS}` array<string>")
    e = spark.createDataFrame([((i * i) % n * 3, (i * 7) % n * 3 if i % 11 else 0, i / 4, f"t{i % 5}", i % 3) for i in range(m)], "a long, b long, w double, t string, n int")
    return v, e


MADE = {}


def written(spark, tmp_path, kind="parquet", **options):
    """An archive in tmp_path; one like it that was written before is copied."""
    g, key = graph(kind, f"file://{tmp_path}/", **options), (kind, tuple(options.items()))
    v, e = frames(spark)
    if key in MADE:
        shutil.copytree(MADE[key], tmp_path, dirs_exist_ok=True)
        return g, v, e
    w = GraphWriter()
    w.put_vertex_data("p", v, "id")
    w.put_edge_data(("p", "k", "p"), e)
    w.write_with_graph_info(spark, g, g.prefix)
    MADE[key] = tmp_path.with_name(tmp_path.name + "-kept")
    shutil.copytree(tmp_path, MADE[key])
    return g, v, e


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """One archive for the tests that only read."""
    return written(spark, tmp_path_factory.mktemp("archive"))


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, kind):
    g, v, e = written(spark, tmp_path, kind)
    vertices, edges = GraphReader.read(f"{g.prefix}g.graph.yml", spark)
    got = vertices["p"].orderBy("vid").collect()
    want = v.orderBy("id").collect()
    assert [(r.vid, r.id, r.name, r.day, r[LABELS]) for r in got] == [(i, r.id, r.name, r.day, r[LABELS]) for i, r in enumerate(want)]
    base = sorted((r.a // 3, r.b // 3, r.w, r.t, r.n) for r in e.collect())
    for layout, df in edges["p", "k", "p"].items():
        rows = df.orderBy("eid").collect()
        assert sorted((r.src, r.dst, r.w, r.t, r.n) for r in rows) == base, layout
        assert [r.eid // 1 for r in rows] == sorted(r.eid for r in rows)
    if kind in ("parquet", "orc"):
        assert DatasetValidator(spark, g, strict=True).validate() == []


def test_chunks_and_counts(spark, shared):
    g, _, e = shared
    vi, ei = g.vertices[0], g.edges[0]
    r = VertexReader(g.prefix, vi, spark)
    assert (r.read_vertices_number(), r.read_vertex_chunk_number()) == (45, 7)
    assert r.read_vertex_property_chunk(vi.property_groups[0], 6).count() == 3
    with pytest.raises(IndexError):
        r.read_vertex_property_chunk(vi.property_groups[0], 7)
    for layout in AdjListType:
        er = EdgeReader(g.prefix, ei, layout, spark)
        assert er.read_edges_number() == 200 and er.read_vertex_chunk_number() == 7
        own = [x // 3 for (x,) in e.select("a" if layout.by_source else "b").collect()]
        assert [er.read_edges_number(p) for p in range(7)] == [sum(x // 7 == p for x in own) for p in range(7)]
        if layout.ordered:
            for p in range(7):
                rows = [x.offset for x in er.read_offset(p).orderBy("vid").collect()]
                ids = range(p * 7, min(45, p * 7 + 7))
                assert rows == [sum(p * 7 <= x < i for x in own) for i in [*ids, ids[-1] + 1]]
            assert {x.vid: x.degree for x in er.degrees_from_offsets().collect()} == {i: own.count(i) for i in range(45)}
            first, end = er.offset_range(9)
            assert end - first == own.count(9) == er.edges_of(9).count()
        else:
            with pytest.raises(ValueError):
                er.read_offset(0)
    chunk = EdgeReader(g.prefix, ei, "ordered_by_source", spark).read_adj_list_chunk(0, 0)
    assert chunk.count() == 13 and chunk.columns == ["src", "dst"]


def test_every_edge_read(spark, shared):
    g, _, _ = shared
    ei = g.edges[0]
    er = EdgeReader(g.prefix, ei, "ordered_by_source", spark)
    a, b = ei.property_groups
    whole = {r.eid: r for r in er.read_edges().collect()}
    assert sorted(whole) == list(range(200))
    for df in (er.read_edge_property_group(a), er.read_multiple_edge_property_groups([a, b]), er.read_all_edge_property_groups()):
        assert all(r.w == whole[r.eid].w for r in df.collect()) and df.count() == 200
    part = {r.eid: r for r in er.read_edges_for_vertex_chunk(2).collect()}
    for df in (er.read_edge_property_group_for_vertex_chunk(b, 2), er.read_multiple_edge_property_groups_for_vertex_chunk([b], 2), er.read_all_edge_property_groups_for_vertex_chunk(2)):
        assert {r.eid: r.t for r in df.collect()} == {k: r.t for k, r in part.items()}
    assert er.read_edge_property_chunk(a, 0, 0).count() == 13
    assert {(r.src, r.dst) for r in er.read_adj_list_for_vertex_chunk(2, False).collect()} == {(r.src, r.dst) for r in part.values()}
    assert er.read_edges(False, ["t"]).columns == ["src", "dst", "t"]
    assert [r.eid for r in er.scan(limit=5).collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(IndexError):
        er.edges_of(45)
    with pytest.raises(KeyError):
        er.read_edges(True, ["none"])


def test_pushdown_and_group_pruning(spark, shared):
    from quiverlake.functions import predicate as P
    from quiverlake.plans.report import ReadRequest, report

    g, _, _ = shared
    r = VertexReader(g.prefix, g.vertices[0], spark)
    one = report(r.read_all_vertex_property_groups(["name"]))
    assert one.scans == 1 and "id" not in one.read_columns
    f = report(ReadRequest(("name",), None, ~P.eq(P.prop("name"), "n1")).apply(r.read_all_vertex_property_groups(["name"])))
    assert any("EqualNullSafe(name,n1)" in x for x in f.pushed_filters)
    e = EdgeReader(g.prefix, g.edges[0], "ordered_by_source", spark)
    pushed = report(e.read_all_adj_list(False).where("src = 3"))
    assert any("EqualTo(_qlSrcIndex,3)" in x for x in pushed.pushed_filters)


def test_points_and_ranges(spark, shared):
    g, v, _ = shared
    r = VertexReader(g.prefix, g.vertices[0], spark)
    assert [x.vid for x in r.read_vertices([9, 3, 9, 30], ["id"]).collect()] == [3, 9, 30]
    for bad in ([45], [-1], [3, 99]):
        with pytest.raises(IndexError):
            r.read_vertices(bad)
    assert [x.vid for x in r.row_range(5, 9, ["id"]).orderBy("vid").collect()] == [5, 6, 7, 8]
    assert r.row_range(50, 60, ["id"]).count() == 0
    assert [x.vid for x in r.scan(["name"], 3).collect()] == [0, 1, 2]
    assert r.read_all_vertex_property_groups([]).count() == 45
    with pytest.raises(KeyError):
        r.read_label_columns(["none"])


def test_empty_types_and_partitions(spark, tmp_path):
    g = graph("parquet", f"file://{tmp_path}/")
    v = spark.createDataFrame([], f"vid long, id long, name string, day date, `{LABELS}` array<string>")
    VertexWriter(g.prefix, g.vertices[0], v).write()
    e = spark.createDataFrame([], "src long, dst long, w double, t string, n int")
    EdgeWriter(g.prefix, g.edges[0], "ordered_by_source", 0, e).write_edges()
    r = EdgeReader(g.prefix, g.edges[0], "ordered_by_source", spark)
    assert VertexReader(g.prefix, g.vertices[0], spark).read_vertex_with_labels().count() == 0 and r.read_edges().count() == 0 and r.read_edges_number() == 0
    some = spark.createDataFrame([(0, 20, 1.0, "a", 1), (0, 20, 1.0, "a", 1), (1, 1, 2.0, None, None)], "src long, dst long, w double, t string, n int")
    EdgeWriter(g.prefix, g.edges[0], "unordered_by_source", 21, some).write_edges()
    r = EdgeReader(g.prefix, g.edges[0], "unordered_by_source", spark)
    assert [r.read_edges_number(p) for p in range(3)] == [3, 0, 0] and r.read_edges().count() == 3
    assert not Store(spark).exists(paths.adj_part(g.prefix, g.edges[0], AdjListType.UNORDERED_BY_SOURCE, 1))
    assert r.edges_of(15).count() == 0


def test_other_prefix_and_write_modes(spark, tmp_path):
    g = graph("parquet", f"file://{tmp_path}/", labels=())
    df = dense_ids(frames(spark)[0].drop(LABELS), ["id"])
    VertexWriter(g.prefix, g.vertices[0], df, reserved=Reserved("_other")).write()
    assert "_otherVertexIndex" in spark.read.parquet(paths.vertex_chunk(g.prefix, g.vertices[0], g.vertices[0].property_groups[0], 0)).columns
    assert VertexReader(g.prefix, g.vertices[0], spark).read_all_vertex_property_groups().columns[0] == "vid"
    with pytest.raises(FileExistsError):
        VertexWriter(g.prefix, g.vertices[0], df, mode=WriteMode.CREATE_NEW).write()
    VertexWriter(g.prefix, g.vertices[0], df.withColumn("name", F.lit("new")), reserved=Reserved("_other")).write_vertex_partition(1)
    rows = VertexReader(g.prefix, g.vertices[0], spark).read_all_vertex_property_groups(["name"]).collect()
    assert {r.vid for r in rows if r.name == "new"} == set(range(7, 14))


def test_validation_levels(spark, tmp_path):
    g = graph("parquet", f"file://{tmp_path}/", labels=())
    df = dense_ids(frames(spark)[0].drop(LABELS), ["id"])
    v = g.vertices[0]
    with pytest.raises(ValueError):
        VertexWriter(g.prefix, v, df.drop("name")).write()
    with pytest.raises(TypeError):
        VertexWriter(g.prefix, v, df.withColumn("day", F.lit(1))).write()
    gap = df.withColumn("vid", F.col("vid") * 2)
    with pytest.raises(ValueError):
        VertexWriter(g.prefix, v, gap, level=ValidateLevel.STRONG).write()
    sets = VertexInfo("s", 5, (PropertyGroup((Property("m", "string", cardinality="set"),)),))
    with pytest.raises(ValueError):
        VertexWriter(g.prefix, sets, spark.createDataFrame([(0, ["a", "a"])], "vid long, m array<string>"), level=ValidateLevel.STRONG).write()
    far = spark.createDataFrame([(50, 0, 1.0, "a", 1)], "src long, dst long, w double, t string, n int")
    with pytest.raises(ValueError):
        EdgeWriter(g.prefix, g.edges[0], "ordered_by_source", 45, far, ValidateLevel.STRONG)


def test_index_generator(spark):
    df = spark.createDataFrame([(k,) for k in ("d", "b", "a", "c")], "k string")
    indexed, mapping = IndexGenerator.vertex_index_and_mapping(df)
    assert {r.k: r.vid for r in indexed.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3} == {r.key: r.vid for r in mapping.collect()}
    with pytest.raises(DuplicateKey):
        IndexGenerator.vertex_index_and_mapping(df.union(df))
    with pytest.raises(ValueError):
        IndexGenerator.vertex_index_and_mapping(spark.createDataFrame([(None,)], "k string"))
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("z", "b", 3)], "s string, t string, w int")
    assert sorted((r.src, r.dst, r.w) for r in IndexGenerator.edges_by_mapping(e, mapping, mapping).collect()) == [(0, 1, 1), (0, 1, 2)]
    with pytest.raises(MissingEnd):
        IndexGenerator.edges_by_mapping(e, mapping, mapping, strict=True)
    assert sorted((r.src, r.dst) for r in IndexGenerator.ends_of_edges_unitedly(e).collect()) == [(0, 1), (0, 1), (2, 1)]
    assert sorted((r.src, r.dst) for r in IndexGenerator.ends_of_edges_separately(e).collect()) == [(0, 0), (0, 0), (1, 0)]
    known = IndexGenerator.string_ids(indexed, "k")
    grown = IndexGenerator.extend(known, spark.createDataFrame([("zz",), ("a",), ("y",), ("y",), (None,)], "id string"))
    assert {r.id: r.vid for r in grown.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "y": 4, "zz": 5}
    many = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    rows = dense_ids(many, ["k"]).orderBy("k").collect()
    assert [r.vid for r in rows] == list(range(5000))


def test_builders(spark, tmp_path):
    g = graph("parquet", f"file://{tmp_path}/", labels=())
    b = VerticesBuilder(g.vertices[0], g.prefix, spark)
    for i in range(10):
        b.add_vertex(id=i)
    b.add_property_column("name", [f"n{i}" for i in range(10)])
    with pytest.raises(ValueError):
        b.add_property_column("name", ["x"])
    with pytest.raises(KeyError):
        b.add_vertex(none=1)
    b.dump()
    assert b.num() == 10 and VertexReader(g.prefix, g.vertices[0], spark).read_all_vertex_property_groups(["name"]).count() == 10
    e = EdgesBuilder(g.edges[0], g.prefix, "ordered_by_dest", 10, spark)
    e.add_edge(1, 2, w=0.5)
    e.add_edge(3, 2)
    e.dump()
    assert sorted((r.src, r.w) for r in EdgeReader(g.prefix, g.edges[0], "ordered_by_dest", spark).edges_of(2).select("src", "w").collect()) == [(1, 0.5), (3, None)]


def test_transform(spark, tmp_path):
    g, v, _ = written(spark, tmp_path / "a")
    dest = graph("orc", f"file://{tmp_path}/b/", size=10, edge_size=50)
    dest = GraphInfo("g2", dest.vertices, (dest.edges[0].without_adj_list("unordered_by_dest"),), dest.prefix)
    GraphTransformer.transform_info(g, dest, spark)
    dest.save(spark, dest.prefix)
    assert DatasetValidator(spark, dest, True).validate() == []
    a, b = (GraphReader.read_with_graph_info(x, spark) for x in (g, dest))
    assert a[0]["p"].select(*sorted(v.columns)).exceptAll(b[0]["p"].select(*sorted(v.columns))).count() == 0
    for layout in ("ordered_by_source", "ordered_by_dest", "unordered_by_source"):
        x, y = (z[1]["p", "k", "p"][layout].drop("eid") for z in (a, b))
        assert x.exceptAll(y).count() == 0 == y.exceptAll(x).count()
    with pytest.raises(KeyError):
        GraphTransformer.transform_info(GraphInfo("e"), dest, spark)


def test_rewritten_partition(spark, tmp_path):
    g, _, _ = written(spark, tmp_path)
    ei, layout = g.edges[0], AdjListType.ORDERED_BY_SOURCE
    er = EdgeReader(g.prefix, ei, layout, spark)
    before = er.read_edges(False)
    other = before.where("src NOT BETWEEN 7 AND 13").collect()
    keep = spark.createDataFrame(before.where("src BETWEEN 7 AND 13 AND w > 20").collect(), before.schema)
    rewrite_edge_partition(g.prefix, ei, layout, 1, keep, 45)
    assert DatasetValidator(spark, GraphInfo("g", g.vertices, (EdgeInfo(*ei.triplet, 13, 7, 7, True, (AdjList(layout),), ei.property_groups),), g.prefix)).validate() == []
    after = er.read_edges(False)
    assert sorted(map(str, after.where("src NOT BETWEEN 7 AND 13").collect())) == sorted(map(str, other))
    assert sorted(map(str, after.where("src BETWEEN 7 AND 13").collect())) == sorted(map(str, keep.collect()))


@pytest.mark.parametrize("step", [0, 1, 2, 4])
def test_a_crash_in_a_rewrite_loses_no_edge(spark, tmp_path, monkeypatch, step):
    """step: how many moves come before the crash; the first one commits the rewrite."""
    info = EdgeInfo("p", "k", "p", 5, 4, 4, True, (AdjList("ordered_by_source"),), (PropertyGroup((Property("w", "int64"),)),))
    prefix, layout = f"file://{tmp_path}/", AdjListType.ORDERED_BY_SOURCE
    old = [(i % 8, i % 7, i) for i in range(24)]
    EdgeWriter(prefix, info, layout, 8, spark.createDataFrame(old, "src long, dst long, w long")).write_edges()
    new = [(1, 5, 100), *[r for r in old if r[0] < 4]]
    done, rename = [], Store.rename

    def failing(self, a, b):
        if "staging" not in a:
            if len(done) == step:
                raise OSError("the power went out")
            done.append(b)
        rename(self, a, b)

    with monkeypatch.context() as m:
        m.setattr(Store, "rename", failing)
        with pytest.raises(OSError):
            rewrite_edge_partition(prefix, info, layout, 0, spark.createDataFrame(new, "src long, dst long, w long"), 8)
    finish_rewrites(spark, prefix, info, layout)
    got = sorted((r.src, r.dst, r.w) for r in EdgeReader(prefix, info, layout, spark).read_edges(False).collect())
    assert got == sorted(old if step == 0 else [*new, *[r for r in old if r[0] >= 4]])
    assert not [f for f in Store(spark).files(prefix) if "/.rewrite" in f or ".old-" in f]


def test_chunks_of_a_union_are_one_file_each(spark, tmp_path):
    """Both sides of the union are dealt by the keys already and are coalesced apart when the plan runs."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        rows = spark.range(6000).select((F.col("id") % 120).alias("k"), F.col("id").alias("x"), F.repeat(F.lit("a"), 20).alias("t"))
        both = rows.repartition("k").unionByName(rows.where("x % 9 = 0").withColumn("x", -F.col("x")).repartition("k"))
        made = write_chunks(both, ["k"], ["x"], ["x", "t"], FileType.PARQUET, f"file://{tmp_path}/c", lambda k: f"file://{tmp_path}/c/chunk{k}", chunks=120)
        assert made == [(k,) for k in range(120)] and len(Store(spark).files(f"file://{tmp_path}/c")) == 120
        assert spark.read.parquet(f"file://{tmp_path}/c/chunk3").toPandas().x.is_monotonic_increasing
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_many_small_chunks_cost_the_driver_nothing(spark, tmp_path, monkeypatch):
    """Tasks write and rename them, replaced ones too; readers give a task many of them."""
    groups = (PropertyGroup((Property("w", "double"),)), PropertyGroup((Property("t", "string"), Property("d", "date"))))
    info = EdgeInfo("p", "k", "p", 5, 40, 40, True, (AdjList("ordered_by_source"),), groups)
    prefix, words = f"file://{tmp_path}/a b/", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id")))
    e = spark.range(4000).select((F.col("id") % 97).alias("src"), (F.col("id") * 7 % 101).alias("dst"), (F.col("id") / 2).alias("w"), words.alias("t"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("d"))
    for df in (e.where("w < 900"), e):  # the older chunks are Spark's own, with checksums beside them
        with monkeypatch.context() as m:
            if df is e:
                m.setattr(Store, "rename", lambda *x: pytest.fail("a rename on the driver"))
            else:
                m.setattr("quiverlake.sinks.chunks.MANY", 10**9)
            EdgeWriter(prefix, info, "ordered_by_source", 100, df)._write_topology()
            for g in groups:
                EdgeWriter(prefix, info, "ordered_by_source", 100, df)._write_group(g)
    w = EdgeWriter(prefix, info, "ordered_by_source", 100, e)
    w.write_edge_counts()
    adj = paths.adj_folder("", info, AdjListType.ORDERED_BY_SOURCE)
    files = [p for p in (tmp_path / "a b" / adj).rglob("*") if p.is_file()]
    assert {p.name[:5] for p in files} == {"chunk"} and len(files) == sum(-(-n // 5) for n in w.counts) and not list(tmp_path.rglob(".staging*"))
    er = EdgeReader(prefix, info, "ordered_by_source", spark)
    want = sorted(e.collect(), key=lambda r: (r.src, r.dst, r.w))
    df = er.read_edges()
    assert df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert [tuple(r)[:2] + (r.w, r.t, r.d) for r in sorted(df.collect(), key=lambda r: r.eid)] == [tuple(r) for r in want]
    one = er.read_edge_property_chunk(groups[1], 1, 3).collect()  # by Spark's source
    part = [r for r in want if r.src // 40 == 1]
    assert [(r.t, r.d) for r in one] == [(r.t, r.d) for r in part[15:20]]
    with pytest.raises(FileExistsError):
        EdgeWriter(prefix, info, "ordered_by_source", 100, e, mode=WriteMode.CREATE_NEW).write_edges()


def test_renames_of_small_chunks_can_be_repeated(tmp_path):
    """A rename that was done already may be repeated; the replaced file's checksum goes."""
    from quiverlake.sinks.chunks import _move

    for name, text in (("old", "a"), ("chunk0", "b"), (".chunk0.crc", "c")):
        (tmp_path / name).write_text(text)
    for _ in range(2):
        _move(f"{tmp_path}/old", f"{tmp_path}/chunk0", set())
    assert [(p.name, p.read_text()) for p in tmp_path.iterdir()] == [("chunk0", "a")]
    with pytest.raises(FileNotFoundError):
        _move(f"{tmp_path}/old", f"{tmp_path}/chunk1", set())


def test_groups_are_read_without_a_shuffle(spark, shared):
    g, _, e = shared
    er = EdgeReader(g.prefix, g.edges[0], "ordered_by_source", spark)
    vr = VertexReader(g.prefix, g.vertices[0], spark)
    for df in (er.read_edges(), er.read_all_edge_property_groups(), vr.read_all_vertex_property_groups(["id", "name"]), vr.read_vertex_with_labels(["name"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    want = sorted((r.a // 3, r.b // 3, r.w, r.t, r.n) for r in e.collect())
    assert sorted((r.src, r.dst, r.w, r.t, r.n) for r in er.read_edges().collect()) == want
    some = er.read_edges(True, ["t"], parts=[1, 4]).collect()
    whole = {r.eid: (r.src, r.dst, r.t) for r in er.read_edges(True, ["t"]).collect()}
    assert {r.eid: (r.src, r.dst, r.t) for r in some} == {k: v for k, v in whole.items() if v[0] // 7 in (1, 4)}
    assert {(r.vid, r.name) for r in vr.read_chunks([1, 3], ["name"]).collect()} == {(r.vid, r.name) for r in vr.read_all_vertex_property_groups(["name"]).collect() if r.vid // 7 in (1, 3)}
    assert [r.dst for r in er.neighbors(9).collect()] == sorted(b for a, b, *_ in want if a == 9)


def test_stored_edges_are_not_taken_for_small(spark, shared):
    """The planner must not broadcast an archive's rows through the driver because they are made from a few chunk numbers."""
    g, *_ = shared
    e = EdgeReader(g.prefix, g.edges[0], "ordered_by_dest", spark).read_edges(False)
    v = VertexReader(g.prefix, g.vertices[0], spark).read_all_vertex_property_groups(["id", "name"])
    for df in (e, v):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40
    both = e.join(v.withColumnRenamed("vid", "dst"), "dst")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 200


def test_control_files(spark, tmp_path):
    p = f"file://{tmp_path}/n"
    write_value(spark, p, 77)
    assert read_value(spark, p) == 77 and (tmp_path / "n").read_bytes() == (77).to_bytes(8, "little")
    with pytest.raises(ValueError):
        write_value(spark, p, -1)
    for bad in (b"123", (2**64 - 5).to_bytes(8, "little")):
        Store(spark).write_bytes(p, bad)
        with pytest.raises(ValueError):
            read_value(spark, p)


def test_validator_codes(spark, tmp_path):
    """One broken copy for each kind of issue."""
    import shutil

    g, _, _ = written(spark, tmp_path / "ok")
    ei, layout = g.edges[0], AdjListType.ORDERED_BY_SOURCE
    store = Store(spark)

    def codes(breaking, tag):
        shutil.copytree(tmp_path / "ok", tmp_path / tag)
        prefix = f"file://{tmp_path}/{tag}/"
        breaking(prefix)
        return {i.code for i in DatasetValidator(spark, GraphInfo("g", g.vertices, g.edges, prefix), True).validate()}

    vi = g.vertices[0]
    group = vi.property_groups[0]

    def put(path, df, extra=""):
        df.coalesce(1).write.parquet(path + ".tmp")
        part = next(p for p, _, _ in store.list(path + ".tmp") if "part-" in p)
        store.rename(part, path)
        store.delete(path + ".tmp")
        local = "/" + path.removeprefix("file:").lstrip("/")
        folder, name = local.rsplit("/", 1)
        store.delete(f"file:{folder}/.{name}.crc")

    chunk = lambda p: paths.vertex_chunk(p, vi, group, 0)
    adj = lambda p: paths.adj_chunk(p, ei, layout, 0, 0)
    off = lambda p: paths.offset_chunk(p, ei, layout, 0)
    ends = lambda rows: spark.createDataFrame(rows, "_qlSrcIndex long, _qlDstIndex long")
    good = [tuple(r) for r in spark.read.parquet(adj(g.prefix)).collect()]
    offsets = [r[0] for r in spark.read.parquet(off(g.prefix)).collect()]
    number = lambda rows, kind="long": spark.createDataFrame([(x,) for x in rows], f"_qlOffset {kind}")
    cases = {
        "MISSING_FILE": lambda p: store.delete(chunk(p)),
        "CONTROL_SIZE": lambda p: store.write_bytes(paths.vertex_count(p, vi), b"1"),
        "CONTROL_NEGATIVE": lambda p: store.write_bytes(paths.edge_count(p, ei, layout, 0), b"\xff" * 8),
        "VERTEX_COUNT_UNAVAILABLE": lambda p: store.delete(paths.vertex_count(p, vi)),
        "EDGE_VERTEX_COUNT_MISMATCH": lambda p: write_value(spark, paths.edge_vertex_count(p, ei, layout), 44),
        "OFFSET_ALIGNMENT_UNKNOWN": lambda p: store.delete(paths.edge_vertex_count(p, ei, layout)),
        "VERTEX_COUNT_MISMATCH": lambda p: write_value(spark, paths.vertex_count(p, vi), 44),
        "CHUNK_ROW_COUNT": lambda p: put(chunk(p), spark.createDataFrame([(0, 0)], "_qlVertexIndex long, id long")),
        "VERTEX_INDEX_SEQUENCE": lambda p: put(chunk(p), spark.createDataFrame([(i, i) for i in (0, 1, 2, 3, 4, 5, 9)], "_qlVertexIndex long, id long")),
        "SCHEMA_MISMATCH": lambda p: [put(paths.vertex_chunk(p, vi, group, c), spark.createDataFrame([(c * 7 + i, "x") for i in range(min(7, 45 - c * 7))], "_qlVertexIndex long, id string")) for c in range(7)],
        "VERTEX_INDEX_TYPE": lambda p: [put(paths.vertex_chunk(p, vi, group, c), spark.createDataFrame([(c * 7 + i, 1) for i in range(min(7, 45 - c * 7))], "_qlVertexIndex int, id long")) for c in range(7)],
        "READ_FAILURE": lambda p: [store.write_bytes(paths.vertex_chunk(p, vi, group, c), b"no parquet") for c in range(7)],
        "TOPOLOGY_ROW_COUNT": lambda p: put(adj(p), ends(good[:-1])),
        "NEGATIVE_ID": lambda p: put(adj(p), ends([(good[0][0], -1), *good[1:]])),
        "DESTINATION_ID_BOUNDS": lambda p: put(adj(p), ends([(good[0][0], 99), *good[1:]])),
        "SOURCE_ID_BOUNDS": lambda p: put(adj(p), ends([*good[:-1], (99, 1)])),
        "PARTITION_ALIGNMENT": lambda p: put(adj(p), ends([*good[:-1], (8, 1)])),
        "ORDEREDNESS": lambda p: put(adj(p), ends([(6, 1), *good[1:]])),
        "OFFSET_ROW_COUNT": lambda p: put(off(p), number(offsets[:-2] + offsets[-1:])),
        "OFFSET_MONOTONICITY": lambda p: put(off(p), number([0, 9, 3, *offsets[3:]])),
        "OFFSET_TERMINAL": lambda p: put(off(p), number([*offsets[:-1], offsets[-1] + 1])),
        "UNORDERED_OFFSET": lambda p: store.write_bytes(paths.offset_chunk(p, ei, AdjListType.UNORDERED_BY_SOURCE, 0), b""),
    }
    for code, breaking in cases.items():
        assert code in CODES and code in codes(breaking, code), code
    assert "OFFSET_TYPE" in codes(lambda p: [put(paths.offset_chunk(p, ei, layout, c), spark.read.parquet(paths.offset_chunk(g.prefix, ei, layout, c)).select(F.col("_qlOffset").cast("int"))) for c in range(7)], "OFFSET_TYPE")
    every = lambda cast: lambda p: [put(f, spark.read.parquet(f.replace("/" + cast, "/ok")).select(F.col("_qlSrcIndex").cast("int"), "_qlDstIndex")) for q in range(7) for f, d, _ in store.list(paths.adj_part(p, ei, layout, q)) if not d]
    assert "TOPOLOGY_TYPE" in codes(every("TOPOLOGY_TYPE"), "TOPOLOGY_TYPE")
