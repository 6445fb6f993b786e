"""Traversals on small hand-built graphs whose answers were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import traverse as T
from graphloom.operators.lookup import in_context
from graphloom.plans import catalog
from graphloom.schema import EDGES


def edges_of(spark, triples):
    rows = []
    for t in triples:
        rel, s, o = t[:3]
        ext = o.startswith("ext:")
        rows.append((f"{rel}{s}{o}", s, None if ext else o, o[4:] if ext else None, rel, None, "EXTRACTED", None, t[3] if len(t) > 3 else None, ext, None, None, None))
    return spark.createDataFrame(rows, EDGES)


@pytest.fixture(scope="module")
def chain(spark):
    return edges_of(spark, [("CALLS", "H", "P"), ("CALLS", "I1", "S"), ("CALLS", "R", "L"), ("OVERRIDES", "I1", "P"), ("OVERRIDES", "I2", "P"), ("OVERRIDES", "R", "S")]).cache()


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted((r.depth, r.source_id, r.target_id) for r in df.collect())


def test_callees(spark, chain):
    assert rows(T.callees(chain, ids(spark, "H"), 5)) == [(1, "H", "P"), (1, "P", "I1"), (1, "P", "I2"), (2, "I1", "S"), (2, "P", "I1"), (2, "P", "I2"), (2, "S", "R"), (3, "R", "L"), (3, "S", "R")]
    assert len(rows(T.callees(chain, ids(spark, "H"), 1))) == 3
    assert rows(T.callees(chain, ids(spark, "P"), 1)) == [(1, "P", "I1"), (1, "P", "I2")]


@pytest.mark.parametrize("seed,depth,count", [("H", 1, 3), ("H", 2, 2), ("H", 5, 0), ("P", 1, 2)])
def test_frontier(spark, chain, seed, depth, count):
    assert T.callees_frontier(chain, ids(spark, seed), depth).first()[0] == count


def test_callers(spark, chain):
    assert rows(T.callers(chain, ids(spark, "L"), 5)) == [(1, "R", "L"), (2, "I1", "S"), (2, "S", "R"), (3, "H", "P"), (3, "P", "I1")]


def test_call_path(spark, chain):
    assert rows(T.call_path(chain, ids(spark, "H"), ids(spark, "L"), 5)) == [(1, "H", "P"), (2, "P", "I1"), (3, "I1", "S"), (4, "S", "R"), (5, "R", "L")]
    assert rows(T.call_path(chain, ids(spark, "H"), ids(spark, "L"), 4)) == []
    assert rows(T.call_path(chain, ids(spark, "H"), ids(spark, "H"), 5)) == []


def test_external_targets_end_there_and_cycles_too(spark):
    e = edges_of(spark, [("CALLS", "a", "b"), ("CALLS", "b", "a"), ("CALLS", "b", "ext:x.Y#z()")])
    assert len(rows(T.callees(e, ids(spark, "a"), 9).where("target_id is not null"))) == 2
    found = e.where("is_external")
    assert sorted((r.depth, r.source_id) for r in T.external_callers(e, found, 2).collect()) == [(1, "b"), (2, "a")]


def test_callbacks(spark):
    e = edges_of(spark, [("CONTAINS", "m", "m$lambda@L1C1"), ("CALLS", "m$lambda@L1C1", "t"), ("CALLS", "m", "u")])
    n = spark.createDataFrame([("m", "METHOD"), ("m$lambda@L1C1", "LAMBDA"), ("t", "METHOD"), ("u", "METHOD")], "id string, kind string")
    got = T.callees(e, ids(spark, "m"), 1, T.callback_bodies(n, e)).collect()
    assert sorted((r.source_id, r.target_id, r.via, r.call_kind) for r in got) == [("m", "t", "m$lambda@L1C1", "CALLBACK"), ("m", "u", None, None)]
    assert [r.source_id for r in T.callers(e, ids(spark, "t"), 1, callbacks=True).collect()] == ["m"]


def test_context_filter(spark):
    e = edges_of(spark, [("CALLS", "a", "b", "for@L1>if-then@L2"), ("CALLS", "a", "c", "if-then@L2"), ("CALLS", "a", "d", None), ("CALLS", "a", "e", "do@L3")])
    assert {r.target_id for r in in_context(e, loop=True).collect()} == {"b", "e"}
    assert {r.target_id for r in in_context(e, loop=True, branch=True).collect()} == {"b"}
    assert in_context(e).count() == 4


def test_taint(spark):
    n = spark.createDataFrame([("s", "TAINT_SOURCE", None), ("v", "LOCAL_DEF", None), ("c", "SANITIZER", None), ("k", "TAINT_SINK", "0"), ("k2", "TAINT_SINK", "1")], "id string, kind string, slot string")
    e = lambda rows: spark.createDataFrame(rows, "source_node string, target_node string, relation string, context string")
    path = lambda rows: [(r.source_id, r.target_id) for r in T.taint_path(n, e(rows)).orderBy("depth").collect()]
    assert path([("s", "v", "DEF_USE", None), ("v", "k", "ARGUMENT_FLOW", "0")]) == [("s", "v"), ("v", "k")]
    assert path([("s", "c", "DEF_USE", None), ("c", "k", "ARGUMENT_FLOW", "0")]) == []
    assert path([("s", "k2", "ARGUMENT_FLOW", "0"), ("s", "k", "DEF_USE", None)]) == []


def test_flow_limit_stops(spark):
    e = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "DEF_USE") for i in range(9)], "id string, source_node string, target_node string, relation string")
    got = T.flow_of(e, ids(spark, "n0"), 8, 3).collect()
    assert sorted((r.id, r.depth) for r in got) == [("e0", 1), ("e1", 2), ("e2", 3)]
    assert T.flow_of(e, ids(spark, "n5"), 2, 9, reverse=True).agg(F.max("depth")).first()[0] == 2


def test_flow_without_a_limit(spark, monkeypatch):
    e = spark.createDataFrame([(f"e{i:03}", f"n{i // 25}", f"n{i // 25 + 1}", "DEF_USE") for i in range(250)], "id string, source_node string, target_node string, relation string")
    assert T.flow_of(e, ids(spark, "n0"), 9, None).count() == 225
    assert T.flow_of(e, ids(spark, "n9"), 2, None, reverse=True).count() == 50
    asked, own = [], T.flow_of
    monkeypatch.setattr(T, "flow_of", lambda edges, starts, depth, limit, **k: asked.append(limit) or own(edges, starts, depth, limit, **k))
    for name in ("flow_of", "flow_of_reverse"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [None, None]


def test_frontiers_and_endpoints(spark, chain):
    assert [T.callers_frontier(chain, ids(spark, "L"), d).first()[0] for d in (1, 2, 3)] == [2, 2, 0]
    e = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "DEF_USE") for i in range(5)], "id string, source_node string, target_node string, relation string")
    assert T.flow_frontier(e, T.flow_of(e, ids(spark, "n0"), 2), 2).first()[0] == 1
    assert T.flow_frontier(e, T.flow_of(e, ids(spark, "n0"), 5), 5).first()[0] == 0
    cov = spark.createDataFrame([("m", "DETAIL"), ("k", "SUMMARY")], "method_id string, detail_level string")
    of = lambda *n: spark.createDataFrame([(x,) for x in n], "method_id string")
    assert T.flow_endpoint(of("m"), cov) == "m"
    for bad in (of("m", "k"), of("k")):
        with pytest.raises(ValueError):
            T.flow_endpoint(bad, cov)
    path = spark.createDataFrame([("m", "k")], "source_id string, target_id string")
    nodes = spark.createDataFrame([("m", "m.src"), ("k", "k.src")], "id string, source_file string")
    assert [r.source_file for r in T.files_to_materialize(path, nodes, cov).collect()] == ["k.src"]
