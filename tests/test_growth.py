"""Steps whose shuffled volume must not outgrow their input, and ties that must not be left to chance."""

import contextlib
import io
import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from graphloom.operators import build as B
from graphloom.operators import change as C
from graphloom.operators import dependency as D
from graphloom.operators import hierarchy as H
from graphloom.operators import search as S
from graphloom.operators import sieve as V
from graphloom.operators import traverse as T
from graphloom.sources import tables as X

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_facts_are_written_without_shuffles_of_text(spark):
    """Nodes and edges come out of tables of keys as they are."""
    for name in ("nodes", "edges"):
        assert "Exchange" not in plan(X._run(spark, SF, X._STATEMENTS[name]))


def test_stored_edges_are_those_of_the_statement(spark):
    made, kept = X._run(spark, SF, X.EDGES_SQL), X.edges(spark, SF)
    assert kept.columns == made.columns
    assert made.exceptAll(kept).isEmpty() and kept.exceptAll(made).isEmpty()


def test_hot_terms_are_parted(spark, tmp_path):
    """a term that all keys have doesn't fall into one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("cast(id as string) as id", "'hot' as term", "1L as tf")
        kept = X._kept(spark, str(tmp_path), "hot_terms", lambda: df)
        assert kept.count() == 4000 and len(kept.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_of_tied_lines(spark, tmp_path):
    """of lines of the same order, part and number, the first in the file stands for the eid."""
    for f in Path(SF).glob("*.parquet"):
        shutil.copyfile(f, tmp_path / f.name)
    lines = pq.read_table(tmp_path / "lineitem.parquet")
    rows = lines.slice(0, 40).to_pylist()
    late = [r | {"l_linestatus": "F" if r["l_linestatus"] == "O" else "O"} for r in rows]
    pq.write_table(pa.concat_tables([lines, pa.Table.from_pylist(late, lines.schema)]), tmp_path / "lineitem.parquet")
    once = lambda d: {r.eid: r.confidence for r in X.edges_once(spark, d).where("relation = 'CALLS'").collect()}
    assert once(str(tmp_path)) == once(SF)


def test_names_are_bound_once(spark):
    """distinct names, not edges, go through the three joins."""
    e = X.edges(spark, SF).where("relation = 'INHERITS'")
    out = e.selectExpr(*[{"external_target_fqn": "target_id as external_target_fqn", "target_id": "cast(null as string) as target_id", "is_external": "true as is_external"}.get(c, c) for c in e.columns])
    bound = B.rebind_external(out, X.nodes(spark, SF))
    assert "keys=[external_target_fqn" in plan(bound)
    assert bound.where("not is_external").select("eid", "target_id").exceptAll(e.select("eid", "target_id")).isEmpty()


def test_edges_are_not_sent_to_all_nodes(spark):
    """edges meet the lost ends only."""
    assert "LeftSemi" not in plan(B.prune(X.edges(spark, SF), X.nodes(spark, SF)))


def test_files_are_grouped_between_the_joins(spark):
    """pairs of ends aren't shuffled to find repeats."""
    assert "keys=[source_id" not in plan(B.file_dependencies(X.edges(spark, SF), X.nodes(spark, SF)))


def test_wiring_at_two_interfaces(spark):
    """F16: the pair comes once, and counts as sure only if it is so at each interface."""
    rows = [("o", "i1", "INJECTS"), ("o", "i2", "INJECTS"), ("a", "i1", "IMPLEMENTS"), ("a", "i2", "IMPLEMENTS"), ("b", "i2", "IMPLEMENTS")]
    e = spark.createDataFrame([(*r, False) for r in rows], "source_id string, target_id string, relation string, is_external boolean")
    got = sorted((r.source_id, r.target_id, r.confidence) for r in B.wire(e).collect())
    assert got == [("o", "a", "AMBIGUOUS"), ("o", "b", "AMBIGUOUS")]


def test_dependencies_are_made_once(spark, monkeypatch):
    """rounds read the written dependencies."""
    made, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: made.append(df.columns) or cut(df))
    deps = spark.createDataFrame([("b", "a"), ("c", "b")], "source_file string, depends_on_file string")
    out = C.impact_closure(deps, spark.createDataFrame([("a",)], "source_file string"), 1_000)
    assert sorted((r.source_file, r.round) for r in out.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert made.count(["source_file", "depends_on_file"]) == 1


def test_packages_are_grouped_between_the_joins(spark):
    """pairs of ends aren't shuffled to be counted."""
    assert "keys=[source_id" not in plan(D.package_dependencies(X.nodes(spark, SF), X.edges(spark, SF)))


def test_levels_of_beans_meet_one_table(spark, monkeypatch):
    """what is below is written once, with its label."""
    made, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: made.append(sorted(df.columns)) or cut(df))
    n = spark.createDataFrame([("1", "B", "BEAN"), ("2", "p", "PROPERTY")], "id string, label string, kind string")
    e = spark.createDataFrame([("1", "2", None, "CONFIGURES", False)], "source_id string, target_id string, external_target_fqn string, relation string, is_external boolean")
    assert sorted(r.path for r in H.bean_tree(n, e, "B").collect()) == ["", "/p"]
    assert made.count(["above", "id", "label"]) == 1


def test_members_meet_few_rows_of_the_large_tables(spark):
    """what can't be a member is left out before the joins, and an edge comes once by either end."""
    n = spark.createDataFrame([("a", "CLASS"), ("a#m", "METHOD"), ("b", "CLASS"), ("b#m", "METHOD")], "id string, kind string")
    rows = [("a", "a#m", "CONTAINS"), ("b", "b#m", "CONTAINS"), ("a", "a#m", "INJECTS"), ("b", "a", "WIRES"), ("b", "b#m", "INJECTS"), (None, "a", "HANDLES")]
    e = spark.createDataFrame([(*r, None) for r in rows], "source_id string, target_id string, relation string, external_target_fqn string")
    a = spark.createDataFrame([("a#m", "x.Y"), ("b#m", "x.Z")], "node_id string, annotation_fqn string")
    out = D.context(n.where("id = 'a'"), n, e, a)
    want = [("annotation", "a#m", "x.Y"), ("framework", "None", "HANDLES a"), ("framework", "a", "INJECTS a#m"), ("framework", "b", "WIRES a"), ("member", "a#m", "METHOD"), ("node", "a", "CLASS")]
    assert sorted((r.section, str(r.id), r.detail) for r in out.collect()) == want
    assert plan(out).count("__bits") >= 4


def test_a_sieve_loses_nothing(spark, monkeypatch):
    """also with far more keys than bits."""
    monkeypatch.setattr(V, "BITS", 2)
    rows = spark.range(3000).selectExpr("cast(id as string) as k", "id").unionByName(spark.sql("select cast(null as string) as k, -1L as id"))
    keys = rows.where("id % 3 = 0").select("k")
    assert V.sifted(rows, "k", keys).join(keys, "k", "left_semi").count() == 1000 == V.semi(rows, "k", keys).count()
    monkeypatch.setattr(V, "BITS", 20)
    assert 1000 <= V.sifted(rows, "k", keys).count() < 1100


def test_only_relations_asked_for_are_built(spark, tmp_path):
    """containment, injection and inheritance don't need the lines joined to their orders; what
    is asked for later is added, and is the statement's."""
    for f in Path(SF).glob("*.parquet"):
        shutil.copyfile(f, tmp_path / f.name)
    d, built = str(tmp_path), lambda: {n for _, f, n in X._indexed if f == str(tmp_path)}
    up = X.edges(spark, d, "INHERITS")
    assert built() == {"edges"}
    few = X.edges(spark, d, "CONTAINS", "INJECTS")
    assert built() == {"edges", "bought", "injected"}
    made = X._run(spark, SF, X.EDGES_SQL)
    for got, own in ((up, "relation = 'INHERITS'"), (few, "relation in ('CONTAINS', 'INJECTS')"), (X.edges(spark, d), "true")):
        want = made.where(own)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_related_documents_count_terms_where_texts_are_read(spark, monkeypatch):
    """the scores are those of the whole index, which isn't made."""
    rows = [(1, "Under a thing, things"), (2, "nothing here"), (3, "the underworld"), (3, "thing"), (4, None), (5, ""), (6, "undue")]
    docs = spark.createDataFrame(rows, "id int, text string")
    index, size = S.asked_counts(docs, "id", ["text"], "thing under un")
    scores = lambda df: {r.id: round(r.score, 9) for r in df.collect()}
    assert scores(S.ranked(index, "id", "thing under un", size=size)) == scores(S.ranked(S.postings(docs, "id", ["text"]), "id", "thing under un"))
    monkeypatch.delattr(S, "postings")
    assert [r.id for r in S.related_documents(docs, "id", ["text"], "thing under", 1, "text").collect()] == [1]


def test_callees_of_members_meet_few_calls(spark, monkeypatch):
    """calls and overrides are sieved, and wide rows aren't sorted to be seen once."""
    rows = [("a", "b", None, "CALLS"), ("a", "b", None, "CALLS"), ("c", "b", None, "OVERRIDES"), ("a", None, "x.Y#z()", "CALLS"), ("d", "a", None, "CALLS"), ("c", "e", None, "CALLS")]
    e = spark.createDataFrame([(*r, r[1] is None, None, None, None, None) for r in rows], "source_id string, target_id string, external_target_fqn string, relation string, is_external boolean, call_kind string, confidence string, context string, source_location string")
    seeds = spark.createDataFrame([("a",)], "id string")
    want = lambda depth: sorted({(r.source_id, r.relation, r.target_id or r.external_target_fqn) for r in T.callees(e, seeds, depth).collect()})
    one, two = want(1), want(2)
    assert one == [("a", "CALLS", "b"), ("a", "CALLS", "x.Y#z()"), ("b", "OVERRIDES", "c")] and two == one + [("c", "CALLS", "e")]
    monkeypatch.delattr(T, "_once")
    assert [sorted(tuple(r) for r in T.called(e, seeds, d).collect()) for d in (1, 2)] == [one, two]
