import pytest

from quiverlake.plans import paths
from quiverlake.plans.info import AdjList, EdgeInfo, GraphInfo, Property, PropertyGroup, Version, VertexInfo, load_graph_info
from quiverlake.plans.types import AdjListType, Cardinality, FileType, Reserved, canonical, spark_type


def person(**options):
    return VertexInfo("person", 100, (PropertyGroup((Property("id", "int64", True),)), PropertyGroup((Property("firstName", "string"), Property("gender", "string")))), **options)


def knows(**options):
    return EdgeInfo("person", "knows", "person", 1024, 100, 100, False, (AdjList("unordered_by_source"), AdjList("ordered_by_source"), AdjList("ordered_by_dest")), (PropertyGroup((Property("creationDate", "string"),)),), **options)


def test_paths():
    v, e = person(), knows()
    assert paths.vertex_chunk("g/", v, v.property_groups[1], 3) == "g/vertex/person/firstName_gender/chunk3"
    assert paths.vertex_count("g/", v) == "g/vertex/person/vertex_count"
    assert paths.label_chunk("g/", v, 0) == "g/vertex/person/labels/chunk0"
    layout = AdjListType.ORDERED_BY_SOURCE
    assert paths.adj_chunk("g/", e, layout, 2, 1) == "g/edge/person_knows_person/ordered_by_source/adj_list/part2/chunk1"
    assert paths.offset_chunk("g/", e, layout, 2) == "g/edge/person_knows_person/ordered_by_source/offset/chunk2"
    assert paths.edge_group_chunk("g/", e, layout, e.property_groups[0], 2, 1) == "g/edge/person_knows_person/ordered_by_source/creationDate/part2/chunk1"
    assert paths.edge_count("g/", e, layout, 7).endswith("ordered_by_source/edge_count7")
    assert [paths.chunk_count(n, 100) for n in (0, 1, 100, 101)] == [0, 1, 1, 2]


def test_types():
    assert canonical("integer") == "int32" and canonical("array<int>") == "list<int32>"
    assert spark_type("list<float>").simpleString() == "array<float>"
    for bad in ("time", "decimal", "list<bool>", "struct<a>"):
        with pytest.raises(ValueError):
            canonical(bad)
    assert AdjListType.of(True, "dst") is AdjListType.ORDERED_BY_DEST
    assert Reserved.found(["a", "_anyPrefixSrcIndex", "_anyPrefixDstIndex"], "SrcIndex", "DstIndex") == ["_anyPrefixSrcIndex", "_anyPrefixDstIndex"]


def test_version():
    v = Version.parse("fam/v1 (t1, t2)")
    assert (v.family, v.number, v.user_types) == ("fam", 1, ("t1", "t2")) and str(v) == "fam/v1 (t1,t2)"
    assert v.knows("int64") and v.knows("t1") and not v.knows("t3")
    with pytest.raises(ValueError):
        Version.parse("one")


def test_copies_on_change():
    v = person()
    g = PropertyGroup((Property("age", "int32"),), "orc")
    grown = v.with_group(g)
    assert not v.has_property("age") and grown.has_property("age") and grown.without_group(g) == v
    with pytest.raises(ValueError):
        grown.with_group(g)
    e = knows().without_adj_list("ordered_by_dest")
    assert not e.has_layout("ordered_by_dest") and knows().has_layout("ordered_by_dest")
    graph = GraphInfo("g").with_vertex(v).with_edge(knows())
    assert graph.without_edge("person", "knows", "person").edges == () and graph.is_validated()
    assert v.primary_key == "id" and v.is_nullable("gender") and not v.is_nullable("id")
    assert [x.names for x in v.groups_of(["gender"])] == [["firstName", "gender"]]
    with pytest.raises(KeyError):
        v.groups_of(["none"])


def test_rules():
    lists = PropertyGroup((Property("x", "list<float>"),), "csv")
    assert any("csv" in i for i in VertexInfo("v", 10, (lists,)).issues())
    assert VertexInfo("v", 0).issues() and VertexInfo("", 1).issues()
    twice = PropertyGroup((Property("a", "int32"), Property("a", "int32")))
    assert VertexInfo("v", 10, (twice,)).issues()
    many = PropertyGroup((Property("e", "string", cardinality=Cardinality.SET),))
    assert VertexInfo("v", 10, (many,)).is_validated()
    assert not EdgeInfo("a", "b", "c", 1, 1, 1, True, (AdjList("ordered_by_source"),), (many,)).is_validated()
    assert not EdgeInfo("a", "b", "c", 1, 1, 1, True, ()).is_validated()
    assert VertexInfo("v", 10, (PropertyGroup((Property("a", "int32"),), FileType.JSON),)).is_validated()
    assert GraphInfo("g", (), (knows(),)).issues()


def test_yaml_round_trip(spark, tmp_path):
    v = person(labels=("a", "b"))
    g = GraphInfo("g", (v,), (knows(),), "./", ("x",), (("k", "v"),), Version.parse("fam/v1 (t)"))
    path = g.save(spark, f"file://{tmp_path}")
    back = load_graph_info(spark, path)
    assert back.vertices == (v,) and back.edges == g.edges and back.extra == g.extra and back.version == g.version
    assert back.prefix == f"file://{tmp_path}/"
    with pytest.raises(KeyError):
        back.vertex("none")
