"""Resolution, building, evidence, change and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import identity as I
from graphloom.operators import build as B
from graphloom.operators import change as C
from graphloom.operators import evidence as V
from graphloom.operators import hierarchy as H
from graphloom.operators import lookup as L
from graphloom.operators import search as S
from graphloom.plans import output
from graphloom.schema import EDGES, NODES, check_version, violations
from graphloom.sources import files
from graphloom.streaming import changes as R


def node(key, label, kind, q, file="a.src", module="m", scope="MAIN", package="p", doc=None):
    return (f"{module}::{scope}::{key}", key, label, kind, q, package, file, "L1", module, scope, doc, None)


def edge(s, t, rel="CALLS", ext=False, file=None, loc=None, eid=None, kind=None, res=None):
    return (eid or f"{rel}{s}{t}{loc}", s, None if ext else t, t if ext else None, rel, kind, "EXTRACTED", res, None, ext, file, loc, None)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([
        node("p.A", "A", "CLASS", "p.A"), node("p.A#m(int)", "m", "METHOD", "p.A#m"), node("p.A#m(int,int)", "m", "METHOD", "p.A#m"),
        node("p.A#x", "x", "FIELD", "p.A#x"), node("q.A", "A", "CLASS", "q.A", "b.src", doc="First one. Second.\n@see x"), node("p.A", "A", "CLASS", "p.A", "t.src", scope="TEST"),
    ], NODES)


def names(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_identity(spark):
    df = spark.createDataFrame([("a:b%", "MAIN", "p.A#m(int,int)")], "m string, s string, y string").withColumn("k", I.storage_key(F.col("m"), F.col("s"), F.col("y")))
    r = df.select("k", I.symbol_of(F.col("k")).alias("y"), I.arity_key(F.col("y")).alias("a"), I.owner_of(F.col("y")).alias("o"), I.is_key(F.col("y")).alias("no")).first()
    assert tuple(r) == ("a%3Ab%25::MAIN::p.A#m(int,int)", "p.A#m(int,int)", "p.A#m/2", "p.A", False)
    docs = spark.createDataFrame([("One. Two.",), ("Only\n line",), ("@tag x",), ("v1.2 stays. End",)], "d string")
    assert [r[0] for r in docs.select(I.doc_summary(F.col("d"))).collect()] == ["One.", "Only line", "@tag x", "v1.2 stays."]
    assert I.glob_regex("a**.b?") == r"^a.*\.b.$"


def test_resolution_tiers(nodes):
    assert names(L.resolve_type(nodes, "p.A#m")) == ["m::MAIN::p.A"]
    assert names(L.resolve_type(nodes, "A")) == ["m::MAIN::p.A", "m::MAIN::q.A"]
    assert names(L.resolve_type(nodes, "A", scope="TEST")) == ["m::TEST::p.A"]
    assert names(L.resolve_method(nodes, "A#m")) == ["m::MAIN::p.A#m(int)", "m::MAIN::p.A#m(int,int)"] == names(L.resolve_method(nodes, "p.A.m"))
    assert names(L.resolve_method(nodes, "p.A#m(int)")) == ["m::MAIN::p.A#m(int)"]
    assert names(L.resolve_field(nodes, "A.x")) == ["m::MAIN::p.A#x"] and L.resolve_type(nodes, "nothing").count() == 0
    with pytest.raises(ValueError):
        L.in_scope(nodes, scope="OTHER")


def test_paging():
    assert L.page_info(10, 4, 8) == {"total": 10, "offset": 8, "returned": 2, "truncated": False, "next_offset": None}
    assert L.page_info(10, 4, 4)["next_offset"] == 8 and L.page_info(3, 4, 9)["returned"] == 0


def test_source_windows(spark):
    lines = L.numbered_lines(spark.createDataFrame([("f", "a\nb\nc\nd")], "source_file string, content string"))
    got = L.source_windows(lines, spark.createDataFrame([("f", "L2"), ("g", "L1"), ("f", None)], "source_file string, source_location string"), 1).collect()
    assert [r.snippet for r in got] == ["1: a\n2: b\n3: c"]


def test_reference_resolution(spark, nodes):
    e = spark.createDataFrame([edge("m::MAIN::p.A#m(int)", "p.A", "REFERENCES", file="a.src"), edge("m::MAIN::q.A", "p.A#x", "READS", file="b.src"), edge("m::MAIN::q.A", "gone.T", "CALLS", file="b.src")], EDGES)
    got = {r.relation: (r.target_id, r.external_target_fqn, r.is_external, r.confidence) for r in B.resolve_references(e, nodes).collect()}
    assert got == {"REFERENCES": ("m::MAIN::p.A", None, False, "EXTRACTED"), "READS": ("m::MAIN::p.A#x", None, False, "EXTRACTED"), "CALLS": (None, "gone.T", True, "AMBIGUOUS")}


def test_rebinding_and_pruning(spark, nodes):
    a = "m::MAIN::q.A"
    e = spark.createDataFrame([edge(a, "p.A#m(long)", ext=True), edge(a, "p$A#x", ext=True, res="reflection"), edge(a, "else.B#c()", ext=True), edge(a, "m::MAIN::none"), edge("m::MAIN::lost", a)], EDGES)
    got = {r.external_target_fqn or r.target_id for r in B.rebind_external(e, nodes).where("source_id like '%q.A'").collect()}
    assert got == {"m::MAIN::p.A#m(int)", "m::MAIN::p.A#x", "else.B#c()", "m::MAIN::none"}
    assert B.prune(e, nodes).count() == 3 and B.dangling(e, nodes).first().n == 2
    assert violations(e).count() == 0
    assert B.backfill_files(e, nodes).where("source_file = 'b.src'").count() == 4


def test_wiring(spark):
    e = spark.createDataFrame([edge("C", "S", "INJECTS"), edge("C", "O", "INJECTS"), edge("I", "S", "IMPLEMENTS"), edge("J", "O", "IMPLEMENTS"), edge("K", "O", "IMPLEMENTS"), edge("C", "K", "WIRES"), edge("C#r()", "S#p()"), edge("I#p()", "S#p()", "OVERRIDES")], EDGES)
    assert sorted((r.target_id, r.confidence) for r in B.wire(e).collect()) == [("I", "INFERRED"), ("J", "AMBIGUOUS")]
    assert [tuple(r) for r in B.injected_calls(e).collect()] == [("C#r()", "I#p()", "INFERRED")]


def test_flow_summaries(spark):
    n = spark.createDataFrame([("m", "p0", "PARAMETER", "0"), ("m", "p1", "PARAMETER", "1"), ("m", "r", "RETURN", None), ("m", "t", "THROW", None)], "method_id string, id string, kind string, slot string")
    e = spark.createDataFrame([("m", "p0", "v"), ("m", "v", "r"), ("m", "p1", "t"), ("m", "v", "p0")], "method_id string, source_node string, target_node string")
    assert sorted((r.input_slot, r.output_slot) for r in B.flow_summaries(n, e).collect()) == [("arg:0", "return"), ("arg:1", "throw")]


def test_overloads_and_last_wins(spark):
    c = spark.createDataFrame([("k", "a", 2, 2, [0, 4]), ("k", "b", 2, 2, [1, 1]), ("k", "c", 1, 2, [0]), ("k", "d", 2, 2, [2, 0])], "call string, candidate string, arity int, wanted_arity int, costs array<int>")
    assert names(B.best_overloads(c), "candidate") == ["b", "d"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "id string, seq long, v string")
    assert sorted(map(tuple, B.last_wins(rows).select("id", "v").collect())) == [("a", "z"), ("b", None)]


def test_hierarchy_keeps_diamonds(spark):
    e = spark.createDataFrame([edge("a", "b", "INHERITS"), edge("a", "c", "INHERITS"), edge("b", "d", "INHERITS"), edge("c", "d", "INHERITS"), edge("d", "e", "INHERITS"), edge("a", "x.Y", "INHERITS", ext=True), edge("a", "f", "IMPLEMENTS")], EDGES)
    seeds = spark.createDataFrame([("a",)], "id string")
    got = sorted((r.source_id, r.target_id or r.external_target_fqn, r.depth) for r in H.hierarchy(e, seeds).collect())
    assert got.count(("d", "e", 3)) == 2 and ("a", "x.Y", 3) in got and ("a", "f", 1) in got and len(got) == 8
    below = H.implementors(e, spark.createDataFrame([("e",)], "id string"), recursive=True).collect()
    assert sorted((r.id, r.depth) for r in below) == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]


def test_search(spark, nodes):
    assert names(S.search(nodes, "seco")) == ["m::MAIN::q.A"] and names(S.search(nodes, '"seco"')) == []
    assert S.search(nodes, "...").count() == 0 and names(S.search(nodes, "x", "FIELD")) == ["m::MAIN::p.A#x"]
    docs = spark.createDataFrame([("a", "graph graph edges"), ("b", "graph of other things entirely here"), ("c", "none")], "path string, content string")
    assert [r.path for r in S.related_documents(docs, "path", ["content"], "graph").orderBy(F.desc("score")).collect()] == ["a", "b"]


def test_external_types(spark):
    e = spark.createDataFrame([edge("a", "x.Y#m()", ext=True), edge("b", "x.Y#n()", ext=True, res="xml"), edge("c", "Z", "INHERITS", ext=True)], EDGES)
    got = {r.external_type: (r.edges, r.relations, r.resolutions) for r in S.external_types(e).collect()}
    assert got == {"x.Y": (2, {"CALLS": 2}, {"classpath": 1, "xml": 1}), "Z": (1, {"INHERITS": 1}, {"classpath": 1})}
    assert names(S.external_types(e, "Y*"), "external_type") == ["x.Y"]


def test_evidence(spark):
    d = spark.createDataFrame([("error", "E1", "resolve_call", "f", "", "MAIN", "s", 2, None), ("warning", "W1", "resolve_call", "f", "", "MAIN", "t", 3, None), ("info", "I1", "parse", "f", "m", "MAIN", None, 1, None)], "severity string, code string, phase string, source_file string, module string, scope string, symbol string, occurrence_count long, sample string")
    cov = V.coverage(d)
    one = cov.where("capability = 'CALL_PATH'").first()
    assert (one.module, one.status, one.occurrences, one.code_counts) == ("*", "failed", 5, {"E1": 2, "W1": 3})
    some, none = d, d.limit(0)
    status = lambda found, caps: V.evidence(found, cov, caps).first().status
    assert [status(some, ["CALL_PATH"]), status(some, ["WIRING"]), status(none, ["CALL_PATH"]), status(none, ["WIRING"])] == ["found_incomplete", "found", "inconclusive", "confirmed_empty"]
    kept = V.retain(d, 2).collect()
    assert [r.code for r in kept][-1] == "DIAGNOSTICS_TRUNCATED" and len(kept) == 3 and V.retain(d, 3).count() == 3
    assert V.health(d).where("phase = 'resolve_call'").first().blocking == ["E1"]
    f = spark.createDataFrame([("f", "m", "MAIN", "resolve_call", "m.X#y", "not found", 3), ("f", "m", "MAIN", "resolve_call", "java.util.List", "?", 4), ("f", "m", "MAIN", "resolve_call", "T", "?", 5)], "source_file string, module string, scope string, phase string, symbol string, message string, line int")
    assert {(r.reason, r.severity) for r in V.resolution_failures(f).collect()} == {("INTERNAL", "warning"), ("PLATFORM", "warning"), ("GENERIC", "info")}


def test_costs():
    assert V.ewma([4, 8]) == 5 and V.ewma([]) is None
    assert V.worth_increment(200, 300) and not V.worth_increment(201, 300) and not V.worth_increment(5, 9999, cap=4)
    assert V.worth_increment(70, 100, 1.0, 100.0) and not V.worth_increment(71, 100, 1.0, 100.0)


def test_changes(spark):
    old = spark.createDataFrame([("a", "1", 5, 1), ("b", "2", 5, 1), ("c", "3", 5, 1), ("d", "4", 5, 1)], "source_file string, hash string, file_size long, file_mtime_ns long")
    new = spark.createDataFrame([("a", "1", 5, 1), ("b", "2", 5, 2), ("c", "9", 5, 1), ("e", "4", 5, 1)], old.schema)
    of = lambda v: {r.source_file: r.change for r in C.file_changes(old, new, v).collect()}
    assert of(False) == {"a": "same", "b": "refresh", "c": "same", "d": "deleted", "e": "added"} and of(True)["c"] == "changed"
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "source_file string, depends_on_file string")
    start = spark.createDataFrame([("a",)], "source_file string")
    assert sorted(map(tuple, C.impact_closure(deps, start, 10).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert C.impact_closure(deps, start, 10, most=1) is None


def test_versions(spark, tmp_path):
    v = C.Versions(spark, str(tmp_path / "v"))
    assert v.current() is None
    first = v.write({"t": spark.range(3)})
    spark.range(9).write.parquet(str(tmp_path / "v" / "half" / "t"))
    assert v.current() == first and v.read("t").count() == 3
    v.write({"t": spark.range(5)})
    assert C.Versions(spark, str(tmp_path / "v")).read("t").count() == 5


def test_stream_retries_and_folds(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, n long"
    spark.createDataFrame([("a", 1), ("a", 2)], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", 3), ("b", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    calls, last = [], []

    def apply(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("once")
        R.upsert_latest(batch, number, str(tmp_path / "out"), "k", "n")
        last.append(number)

    R.run_to_end(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), apply, str(tmp_path / "check"), delay=0)
    got = R.latest(spark, str(tmp_path / "out"), last[-1])
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 3), ("b", 1)] and calls[:2] == [0, 0]


def test_stream_failure_stays_pending(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    with pytest.raises(Exception):
        R.run_to_end(stream, lambda b, n: 1 / 0, str(tmp_path / "c"), attempts=2, delay=0)
    seen = []
    R.run_to_end(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "c"))
    assert seen == [3]


def test_file_sources(spark, tmp_path):
    for name, text in {"docs/guide.md": "# The Guide\nx", "README.md": "no heading", "core/ADR-1.md": "# Why\n", "CHANGELOG.md": "# c", "build/docs/x.md": "# b", "s/A.java": "class A {}", "s/gen/B.java": "class B {}"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = sorted((r.path, r.title, r.doc_type, r.module) for r in files.documents(spark, str(tmp_path)).collect())
    assert got == [("README.md", "README", "README", None), ("core/ADR-1.md", "Why", "ADR", "core"), ("docs/guide.md", "The Guide", "DOC", "docs")]
    assert names(files.source_files(spark, str(tmp_path / "s"), excludes=["gen/*"]), "source_file") == ["A.java"]


def test_beans(spark):
    xml = '<beans><bean id="a" class="x.A"><property name="p" ref="b"/><constructor-arg><list><ref bean="c"/></list></constructor-arg></bean><bean id="b" class="x.B"/></beans>'
    n, e = files.xml_beans(spark.createDataFrame([("ctx.xml", xml), ("bad.xml", "<x")], "source_file string, content string"))
    n, e = n.cache(), e.cache()
    assert n.where("kind = 'BEAN'").count() == 2 and e.where("relation = 'DEFINED_BY'").count() == 2
    assert sorted(r.target_id for r in files.bean_wires(e).collect()) == ["bean:b@ctx.xml", "bean:c@ctx.xml"]
    tree = {r.path: r.refers_to for r in H.bean_tree(n, e, "a").collect()}
    assert tree == {"": None, "/p": "bean:b@ctx.xml", "/constructor-arg": None, "/constructor-arg/list": None, "/constructor-arg/list/c": "bean:c@ctx.xml"}


def test_rules(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"sources": ["in.*"], "sinks": ["*.exec(?)"]}))
    calls = spark.createDataFrame([("in.read()",), ("rt.exec(x)",), ("rt.exec()",)], "callee_method string")
    assert [r.taint for r in files.classify(calls, files.taint_rules(str(p))).collect()] == ["TAINT_SOURCE", "TAINT_SINK", None]
    p.write_text(json.dumps({"sinks": ["x" * 513]}))
    with pytest.raises(ValueError):
        files.taint_rules(str(p))


def test_output(spark):
    got = json.loads(output.envelope({"q": 1}, spark.range(2), {}, {"status": "found"}, output.follow_ups("x", L.page_info(9, 2, 0), 3, True)))
    assert got["results"] == [{"id": 0}, {"id": 1}] and got["next_queries"] == ["x --offset 2", "x --depth 6"]
    text = output.markdown("T", {"rows": spark.range(300)}, limit=250)
    assert text.startswith("# T") and text.endswith("(cut)") and len(text.splitlines()) == 201


def test_schema_version():
    with pytest.raises(ValueError):
        check_version(11)


def test_readiness():
    assert V.readiness(12, 12, 5, False, {"parse": "complete"})["status"] == "READY"
    assert V.readiness(12, 12, 5, False, {"resolution": "partial"})["status"] == "DEGRADED"
    assert V.readiness(None, 12, 0, True, {"graph": "failed"})["blockers"] == ["INDEX_MISSING", "INDEX_STALE", "GRAPH_INTEGRITY_FAILED"]
    assert V.readiness(11, 12, 5, False, {})["blockers"] == ["SCHEMA_MISMATCH"] and V.freshness("IDLE", "REBUILDING") == "REBUILDING"
    with pytest.raises(ValueError):
        V.freshness("REBUILDING", "INCREMENTAL")


def test_meta_and_branch_words(spark):
    m = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert sorted(map(tuple, L.put_meta(m(("a", "1"), ("b", "2")), m(("b", "3"), ("c", None))).collect())) == [("a", "1"), ("b", "3"), ("c", None)]
    e = spark.createDataFrame([("m", "if-then@L1", "Target", None, "f.src"), ("n", "case@L2", None, "x.Y", None)], "source_id string, context string, target_id string, external_target_fqn string, source_file string")
    s = e.select("source_id", "context")
    assert names(L.branch_keyword(s, e, "targ"), "source_id") == ["m"] and names(L.branch_keyword(s, e, "CASE"), "source_id") == ["n"] and names(L.branch_keyword(s, e, "f.src"), "source_id") == ["m"]
