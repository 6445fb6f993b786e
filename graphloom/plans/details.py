"""More queries over whole tables, for the operators that the catalog's first ones don't reach, and
those that compare rows where the first ones compare counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import identity as I
from graphloom.operators import build as B
from graphloom.operators import change as C
from graphloom.operators import dependency as D
from graphloom.operators import evidence as V
from graphloom.operators import hierarchy as H
from graphloom.operators import lookup as L
from graphloom.operators import search as S
from graphloom.operators import traverse as T
from graphloom.plans.catalog import _DIAG, _REACH, ORACLE, _diagnostics, _event_stream, _new, _old, _seeds, _symbols, query
from graphloom.sources import tables as X
from graphloom.sources.tables import load, oracle_with
from graphloom.storage import scratch

# lookups and filters

@query("SELECT eid FROM edges WHERE is_external AND relation = 'CALLS' AND (external_target_fqn = '/the#get()' OR starts_with(lower(external_target_fqn), '/de#get('))", ("edges",))
def external_calls_named(s, d):
    e = X.edges(s, d)
    return L.external_calls(e, "/the#get()").unionByName(L.external_calls(e, "/DE#get")).select("eid")


@query("SELECT id, scope FROM (SELECT id, CASE WHEN kind = 'FIELD' THEN 'TEST' ELSE scope END AS scope FROM nodes) WHERE scope = 'TEST' UNION ALL SELECT id, 'ALL' FROM nodes", ("nodes",))
def nodes_in_scope(s, d):
    n = X.nodes(s, d).withColumn("scope", F.when(F.col("kind") == "FIELD", "TEST").otherwise(F.col("scope")))
    return L.in_scope(n, "star", "TEST").select("id", "scope").unionByName(L.in_scope(n, "star", "ALL").select("id", F.lit("ALL").alias("scope"))).unionByName(L.in_scope(n, "none").select("id", "scope"))


@query("""SELECT 1 AS asked, id FROM nodes WHERE kind = 'METHOD' AND qualified_name LIKE '%.R2#hub' UNION ALL SELECT 2, id FROM nodes WHERE label = 'S7' AND kind IN ('CLASS','INTERFACE')
UNION ALL SELECT 3, id FROM nodes WHERE label = 'hub' AND kind = 'METHOD' UNION ALL SELECT 4, id FROM nodes WHERE qualified_name = 'geo.R1' AND kind = 'CLASS'""", ("nodes",))
def resolve_node_candidates(s, d):
    n = X.nodes(s, d)
    out = None
    for k, ref in enumerate(("R2#hub", "S7", "hub", "geo.R1#gone"), 1):
        part = L.resolve_node(n, ref).select(F.lit(k).alias("asked"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT eid FROM edges e LEFT JOIN nodes a ON e.source_id = a.id LEFT JOIN nodes b ON e.target_id = b.id WHERE relation IN ('CALLS','INJECTS') AND (lower(coalesce(a.label,'')) LIKE '%s1%' OR lower(coalesce(b.label,'')) LIKE '%s1%' OR lower(coalesce(target_id,'')) LIKE '%s1%' OR lower(coalesce(b.qualified_name,'')) LIKE '%s1%' OR lower(coalesce(external_target_fqn,'')) LIKE '%s1%')", ("nodes", "edges"))
def keyword_narrow(s, d):
    return L.keyword(L.with_ends(X.edges(s, d).where("relation in ('CALLS', 'INJECTS')"), X.nodes(s, d)), "S1", narrow=True).select("eid")


@query("""SELECT source_id, context, n FROM (SELECT source_id, context, count(*) AS n, bool_or(lower(coalesce(target_id, external_target_fqn)) LIKE '%t17%' OR lower(source_file) LIKE '%t17%') AS hit FROM edges
WHERE relation IN ('CALLS','READS','WRITES') AND regexp_matches(context, '(^|>)(if-then|if-else|case|default|ternary-then|ternary-else|catch)@') GROUP BY 1, 2) WHERE hit OR lower(source_id) LIKE '%t17%' OR lower(context) LIKE '%t17%'""", ("edges",))
def branch_keyword(s, d):
    e = X.edges(s, d)
    return L.branch_keyword(D.branch_slices(e), e.where("relation in ('CALLS', 'READS', 'WRITES')"), "T17").select("source_id", "context", "n")


@query(f"SELECT code, symbol FROM ({_DIAG}) WHERE contains(source_file, 'user3') AND severity = 'error' AND phase = 'resolve_type'")
def diagnostics_filter(s, d):
    return L.diagnostics_like(_diagnostics(s, d), "user3", severity="ERROR", phase="Resolve_Type").select("code", "symbol")


@query("SELECT eid FROM edges WHERE relation = 'INJECTS'", ("edges",))
def generated_edges(s, d):
    via = F.when(F.col("relation") == "INJECTS", F.lit('{"via":"injection"}')).when(F.col("relation") == "READS", F.lit('{"via":"source"}'))
    return L.made_by_injection(X.edges(s, d).withColumn("metadata", via)).select("eid")


@query("SELECT id, CASE kind WHEN 'TAINT_SOURCE' THEN 'arg:0' WHEN 'TAINT_SINK' THEN 'return' ELSE 'throw' END AS slot FROM fnodes WHERE kind IN ('TAINT_SOURCE','TAINT_SINK','SANITIZER') UNION ALL SELECT id, 'any' FROM fnodes", ("fnodes",))
def flow_slots(s, d):
    n = _as_methods(X.flow_nodes(s, d))
    out = L.slot(n, None).select("id", F.lit("any").alias("slot"))
    for name in ("arg:0", "arg:1", "return", "throw"):
        out = out.unionByName(L.slot(n, name).select("id", F.lit(name).alias("slot")))
    return out


@query("SELECT id FROM nodes WHERE regexp_full_match(qualified_name, 'catalog\\.T1.*#ma.e')", ("nodes",))
def full_glob(s, d):
    return X.nodes(s, d).where(F.col("qualified_name").rlike(I.glob_regex("catalog.T1**#ma?e"))).select("id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN regexp_matches(o_orderpriority, '^[A-Za-z0-9_./:@%+=,-]+$') THEN o_orderpriority ELSE '''' || o_orderpriority || '''' END AS word FROM orders")
def shell_words(s, d):
    return load(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), I.shell_quoted(F.col("o_orderpriority")).alias("word"))


@query("SELECT node_id, json_merge_patch(attributes, '{\"seen\":\"yes\"}') AS attributes FROM annotations", ("annotations",))
def json_set_attribute(s, d):
    return X.annotations(s, d).select("node_id", I.json_with(F.col("attributes"), "seen", F.lit("yes")).alias("attributes"))


@query("SELECT id, javadoc AS body, javadoc IS NOT NULL AS known FROM nodes", ("nodes",))
def javadoc_bodies(s, d):
    long = F.concat("javadoc", F.lit("\n\n"), F.lit("More of it.\n@since 1"))
    return X.nodes(s, d).select("id", I.doc_body(long).alias("body"), F.col("javadoc").isNotNull().alias("known"))


@query("SELECT target_id AS id, split_part(source_id, '#', 1) || '#' || split_part(source_id, '#', 2) AS caller FROM edges WHERE relation = 'CALLS' AND NOT is_external", ("edges",))
def caller_rewrite(s, d):
    body = F.when(F.col("source_location") == "L1", "$lambda@7#apply()").when(F.col("source_location") == "L2", "$anon@3#run()$lambda@9").otherwise("")
    own = X.edges(s, d).where("relation = 'CALLS' and not is_external")
    return own.select(F.col("target_id").alias("id"), I.enclosing_method(F.concat("source_id", body)).alias("caller"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS value FROM nation WHERE n_nationkey < 20 OR n_regionkey = 1")
def meta_rows(s, d):
    n = load(s, d, "nation")
    meta = n.where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    new = n.where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key"), F.lit("moved").alias("value"))
    return L.get_meta(L.put_meta(meta, new))


@query("""SELECT doc_id, array_to_string(list_transform(range(1, least(3, len(l)) + 1), lambda i: CAST(i AS VARCHAR) || ': ' || l[i]), chr(10)) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""")
def source_snippets(s, d):
    files = load(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("source_file"), F.col("text").alias("content"))
    places = files.select("source_file", F.lit("L2").alias("source_location"))
    return L.source_windows(L.numbered_lines(files), places, 1).select(F.col("source_file").alias("doc_id"), "snippet")


# search

_EXT = "SELECT split_part(external_target_fqn, '#', 1) AS x, relation, coalesce(resolution, 'classpath') AS resolution, confidence FROM edges WHERE is_external"


def _tally(c: str) -> str:
    return f"(SELECT x, '{{{{' || string_agg('\"' || k || '\":' || CAST(n AS VARCHAR), ',' ORDER BY k) || '}}}}' AS {c} FROM (SELECT x, {c} AS k, count(*) AS n FROM ({_EXT}) GROUP BY 1, 2) GROUP BY x)".replace("{{", "{").replace("}}", "}")


@query(f"SELECT x AS external_type, n AS edges, relations, resolutions, confidences FROM (SELECT x, count(*) AS n FROM ({_EXT}) GROUP BY x) JOIN {_tally('relation').replace('AS relation FROM', 'AS relations FROM')} USING (x) JOIN {_tally('resolution').replace('AS resolution FROM', 'AS resolutions FROM')} USING (x) JOIN {_tally('confidence').replace('AS confidence FROM', 'AS confidences FROM')} USING (x)", ("edges",))
def external_type_tallies(s, d):
    return S.external_types(X.edges(s, d)).select("external_type", "edges", *[F.to_json(c).alias(c) for c in ("relations", "resolutions", "confidences")])


@query(f"SELECT x AS external_type, count(*) AS edges FROM ({_EXT}) GROUP BY x ORDER BY edges DESC, x LIMIT 25", ("edges",))
def external_types_top(s, d):
    """The 25 types of most edges, ties by name."""
    return S.by_edges(S.external_types(X.edges(s, d))).limit(25).select("external_type", "edges")


@query(f"""SELECT ordinal, id, label, edges, total, label_matches FROM (SELECT *, count(*) FILTER (contains(lower(label), 'ou')) OVER () AS label_matches FROM (SELECT *, CAST(row_number() OVER (ORDER BY part, edges DESC, name, id) AS INT) AS ordinal, count(*) OVER () AS total FROM (
SELECT 0 AS part, id, label, qualified_name AS name, CAST(0 AS BIGINT) AS edges FROM nodes WHERE label ILIKE '%ou%' UNION ALL SELECT 1, x, split_part(x, '.', -1), x, count(*) FROM ({_EXT}) GROUP BY x)) WHERE ordinal > 15 AND ordinal <= 55)""", ("nodes", "edges"))
def search_page(s, d):
    """The third page and on of 40 rows: real nodes first, then virtual types."""
    return S.search_page(L.by_label_glob(X.nodes(s, d), "*ou*"), S.external_types(X.edges(s, d)), "*ou*", 40, 15).select("ordinal", "id", "label", "edges", "total", "label_matches")


@query("SELECT doc_id, snippet FROM (SELECT r.doc_id, score, substr(text, 1, 200) AS snippet FROM (" + ORACLE["rank_documents"] + ") r JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 3)")
def related_documents(s, d):
    """The three best documents for a question."""
    return S.related_documents(load(s, d, "documents"), "doc_id", ["text"], "thing under", 3, "text").select("doc_id", "snippet")


# callbacks and closures

def _nested(s, d, *relations):
    """Parts as bodies that hold the bodies of the parts below them, all within the first one."""
    n, e = X.nodes(s, d).where("id like 'star::MAIN::catalog.T%' and kind = 'CLASS'"), X.edges(s, d, "INHERITS", *relations)
    bodies = n.withColumn("kind", F.when(F.col("label") == "T1", "METHOD").otherwise("LAMBDA"))
    holds = e.where("relation = 'INHERITS'").withColumn("relation", F.lit("CONTAINS")).withColumn("up", F.col("target_id")).withColumn("target_id", F.col("source_id")).withColumn("source_id", F.col("up")).drop("up")
    calls = e.where("relation = 'CALLS'").withColumn("source_id", F.when(F.col("source_id").contains("::catalog."), I.owner_of(F.col("source_id"))).otherwise(F.col("source_id")))
    return bodies, holds, calls


@query("SELECT 'star::MAIN::catalog.T1' AS outer_id, id AS body FROM nodes WHERE kind = 'CLASS' AND id LIKE 'star::MAIN::catalog.T%' AND label NOT IN ('T0','T1')", ("nodes",))
def callback_bodies(s, d):
    bodies, holds, _ = _nested(s, d)
    return T.callback_bodies(bodies, holds).select(F.col("outer").alias("outer_id"), "body")


@query("SELECT DISTINCT 'star::MAIN::catalog.T1' AS source_id, target_id, CASE WHEN split_part(source_id, '#', 1) <> 'star::MAIN::catalog.T1' THEN split_part(source_id, '#', 1) END AS via FROM edges WHERE relation = 'CALLS' AND source_id LIKE 'star::MAIN::catalog.T%' AND source_id NOT LIKE 'star::MAIN::catalog.T0#%'", ("edges",))
def callees_through_callbacks(s, d):
    bodies, holds, calls = _nested(s, d, "CALLS")
    found = T.with_callbacks(calls.where("target_id is not null"), T.callback_bodies(bodies, holds))
    return found.where("source_id = 'star::MAIN::catalog.T1'").select("source_id", "target_id", "via").distinct()


@query("SELECT CAST(3 AS INT) AS length FROM nodes WHERE id = 'star::MAIN::catalog.T1'", ("nodes",))
def call_path_through_callbacks(s, d):
    """From the outermost body's calls to a hub: part, supplier, nation, region."""
    bodies, holds, calls = _nested(s, d, "CALLS")
    n = X.nodes(s, d)
    return T.call_path(calls, n.where("id = 'star::MAIN::catalog.T1'").select("id"), n.where("label = 'hub'").select("id"), 6, T.callback_bodies(bodies, holds)).agg(F.max("depth").alias("length"))


_BEANS = """, b AS (SELECT id, label FROM nodes WHERE kind = 'CLASS' AND id LIKE 'star::MAIN::catalog.T%' AND label ILIKE '%T1%' ORDER BY label <> 'T1', label, id LIMIT 20),
w(bean, id, path) AS (SELECT id, id, '' FROM b UNION ALL SELECT bean, e.source_id, path || '/' || n.label FROM w JOIN edges e ON e.target_id = w.id AND relation = 'INHERITS' JOIN nodes n ON n.id = e.source_id)
SELECT bean, path, w.id, e.target_id AS refers_to FROM w LEFT JOIN edges e ON e.source_id = w.id AND relation = 'IMPLEMENTS'"""


@query(None)
def bean_tree(s, d):
    """Parts as beans that configure the parts below them, to the last level."""
    bodies, holds, _ = _nested(s, d)
    refers = X.edges(s, d).where("relation = 'IMPLEMENTS'").withColumn("relation", F.lit("XML_REFERS_TO"))
    return H.bean_tree(bodies.withColumn("kind", F.lit("BEAN")), holds.withColumn("relation", F.lit("CONFIGURES")).unionByName(refers), "T1")


ORACLE["bean_tree"] = oracle_with("nodes", "edges") + _BEANS

# traversals, by rows

@query(None)
def callees_bridged_rows(s, d):
    return T.callees(X.edges(s, d), _seeds(X.nodes(s, d)), 3).where("relation = 'OVERRIDES'").select("source_id", "target_id", "depth")


ORACLE["callees_bridged_rows"] = oracle_with("nodes", "edges") + _REACH.format(depth=3) + "SELECT source_id, target_id, depth FROM rows WHERE relation = 'OVERRIDES'"


@query("SELECT count(*) AS frontier_count FROM nodes WHERE label = 'ship'", ("nodes",))
def callers_frontier(s, d):
    """Suppliers call nations, that call the hubs; all of them are beyond one level."""
    return T.callers_frontier(X.edges(s, d), X.nodes(s, d).where("label = 'hub'").select("id"), 1)


@query("""SELECT DISTINCT source_id, target_id, external_target_fqn, CAST(depth AS INT) AS depth FROM (SELECT source_id, target_id, external_target_fqn, 1 AS depth FROM edges WHERE is_external AND relation = 'CALLS' AND starts_with(external_target_fqn, '/th')
UNION ALL SELECT 'star::MAIN::shop', source_id, NULL, 2 FROM edges WHERE is_external AND relation = 'CALLS' AND starts_with(external_target_fqn, '/th') UNION ALL SELECT 'star::MAIN::mall', 'star::MAIN::shop', NULL, 3 WHERE EXISTS (SELECT 1 FROM edges WHERE is_external AND starts_with(external_target_fqn, '/th')))""", ("edges",))
def callers_external_deep(s, d):
    """Pages call outside; a shop calls all pages, a mall the shop."""
    e = X.edges(s, d)
    pages = e.where("is_external").select(F.col("source_id").alias("target_id")).distinct().withColumn("source_id", F.lit("star::MAIN::shop"))
    mall = s.createDataFrame([("star::MAIN::shop", "star::MAIN::mall")], "target_id string, source_id string")
    own = {"relation": F.lit("CALLS"), "is_external": F.lit(False), "target_id": F.col("target_id"), "source_id": F.col("source_id"), "eid": F.concat("source_id", F.lit(">"), F.col("target_id"))}
    more = pages.select("target_id", "source_id").unionByName(mall).select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema])
    found = e.where(F.col("is_external") & (F.col("relation") == "CALLS") & F.col("external_target_fqn").startswith("/th"))
    return T.external_callers(e.unionByName(more), found, 3).select("source_id", "target_id", "external_target_fqn", "depth")


@query("SELECT DISTINCT source_file FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE relation = 'CALLS' AND target_id IN (SELECT id FROM nodes WHERE label = 'route') UNION SELECT target_id FROM edges WHERE relation = 'CALLS' AND target_id IN (SELECT id FROM nodes WHERE label = 'route')) AND label <> 'route'", ("nodes", "edges"))
def files_to_materialize(s, d):
    n, e = X.nodes(s, d), X.edges(s, d)
    done = n.where("label = 'route'").select(F.col("id").alias("method_id"), F.lit("DETAIL").alias("detail_level"))
    return T.files_to_materialize(T.callers(e, n.where("label = 'route'").select("id"), 1), n, done)


# flow

def _as_methods(n):
    """Sources as parameters, sinks as returns, sanitizers as throws."""
    kind = F.when(F.col("kind") == "TAINT_SOURCE", "PARAMETER").when(F.col("kind") == "TAINT_SINK", "RETURN").when(F.col("kind") == "SANITIZER", "THROW").otherwise(F.col("kind"))
    return n.withColumn("slot", F.when(F.col("kind") == "TAINT_SOURCE", "0")).withColumn("kind", kind)


_SUMMARY = """, o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), p AS (SELECT user_id, min(k) AS k FROM o WHERE event_type = 'signup' GROUP BY 1)
SELECT DISTINCT 'u' || CAST(o.user_id AS VARCHAR) AS method_id, 'arg:0' AS input_slot, CASE event_type WHEN 'purchase' THEN 'return' ELSE 'throw' END AS output_slot, 'DEF_USE' AS relation FROM o JOIN p ON o.user_id = p.user_id AND o.k > p.k WHERE event_type IN ('purchase','error')"""


@query("WITH one AS (SELECT 1)" + _SUMMARY)
def flow_summaries(s, d):
    return B.flow_summaries(_as_methods(X.flow_nodes(s, d)), X.flow_edges(s, d))


@query("WITH one AS (SELECT 1)" + _SUMMARY.replace("SELECT DISTINCT", "SELECT * FROM (SELECT DISTINCT") + ") WHERE method_id = 'u7'")
def flow_summary(s, d):
    return T.flow_summary(B.flow_summaries(_as_methods(X.flow_nodes(s, d)), X.flow_edges(s, d)), "u7")


@query("SELECT e.method_id, relation, source_node, a.kind AS source_kind, target_node, b.kind AS target_kind FROM (SELECT * REPLACE ('EXCEPTION_FLOW' AS relation) FROM fedges WHERE relation = 'ARGUMENT_FLOW') e JOIN fnodes a ON a.id = source_node JOIN fnodes b ON b.id = target_node", ("fnodes", "fedges"))
def exception_flow(s, d):
    e = X.flow_edges(s, d).withColumn("relation", F.when(F.col("relation") == "ARGUMENT_FLOW", "EXCEPTION_FLOW").otherwise(F.col("relation")))
    return T.exception_flow(X.flow_nodes(s, d), e).select("method_id", "relation", "source_node", "source_kind", "target_node", "target_kind")


_LEVELS = """, w(id, d) AS (SELECT id, 0 FROM fnodes WHERE kind = 'TAINT_SOURCE' UNION SELECT target_node, d + 1 FROM w JOIN fedges ON source_node = w.id WHERE d < {depth}), lv AS (SELECT id, min(d) AS d FROM w GROUP BY id),
met AS (SELECT f.id, f.source_node, f.target_node, lv.d + 1 AS depth FROM fedges f JOIN lv ON lv.id = source_node WHERE lv.d < {depth}) """


@query(None)
def flow_frontier(s, d):
    e = X.flow_edges(s, d)
    return T.flow_frontier(e, T.flow_of(e, X.flow_nodes(s, d).where("kind = 'TAINT_SOURCE'"), 2, None), 2)


ORACLE["flow_frontier"] = oracle_with("fnodes", "fedges") + _LEVELS.format(depth=2) + "SELECT count(DISTINCT source_node) AS frontier_count FROM fedges WHERE source_node IN (SELECT target_node FROM met WHERE depth = 2) AND source_node NOT IN (SELECT source_node FROM met) AND id NOT IN (SELECT id FROM met)"


@query(None)
def flow_of_limited(s, d):
    """The first 700 edges by depth and id, the budget that a flow question has."""
    return T.flow_of(X.flow_edges(s, d), X.flow_nodes(s, d).where("kind = 'TAINT_SOURCE'"), 3, 700).select("id", "depth")


ORACLE["flow_of_limited"] = oracle_with("fnodes", "fedges") + _LEVELS.format(depth=3) + "SELECT id, depth FROM met ORDER BY depth, id LIMIT 700"

# fact construction, by rows

@query("""SELECT eid, k.id AS target_id, CASE WHEN e.sym IS NOT NULL AND k.id IS NULL THEN 'AMBIGUOUS' ELSE confidence END AS confidence, k.id IS NULL AS is_external, CASE WHEN e.sym IS NOT NULL AND k.id IS NULL THEN e.sym ELSE external_target_fqn END AS external_target_fqn
FROM (SELECT DISTINCT ON (eid) *, CASE WHEN NOT is_external THEN split_part(target_id, '::', 3) || CASE WHEN source_location = 'L7' THEN '?' ELSE '' END END AS sym FROM edges) e LEFT JOIN (SELECT symbol_id, min(id) AS id FROM nodes GROUP BY 1 HAVING count(*) = 1) k ON k.symbol_id = e.sym""", ("nodes", "edges"))
def tiered_resolution_rows(s, d):
    symbol = I.symbol_of(F.col("target_id"))
    e = X.edges_once(s, d).withColumn("target_id", F.when(F.col("source_location") == "L7", F.concat(symbol, F.lit("?"))).otherwise(symbol))
    return B.resolve_references(e, X.nodes(s, d)).select("eid", "target_id", "confidence", "is_external", "external_target_fqn")


@query("SELECT eid, CASE WHEN source_location <> 'L7' THEN target_id END AS target_id, source_location = 'L7' AS is_external FROM edges WHERE NOT is_external", ("edges",))
def external_rebind_rows(s, d):
    symbol = I.symbol_of(F.col("target_id"))
    e = X.edges(s, d).where("not is_external").withColumn("external_target_fqn", F.when(F.col("source_location") == "L7", F.concat(symbol, F.lit("?"))).otherwise(symbol))
    out = e.withColumn("target_id", F.lit(None).cast("string")).withColumn("is_external", F.lit(True)).withColumn("resolution", F.lit("classpath"))
    return B.rebind_external(out, X.nodes(s, d)).select("eid", "target_id", "is_external")


@query("SELECT eid, source_file FROM edges", ("edges",))
def provenance_backfill_rows(s, d):
    e = X.edges(s, d).withColumn("source_file", F.when(F.col("relation") != "CALLS", F.col("source_file")))
    return B.backfill_files(e, X.nodes(s, d)).select("eid", "source_file")


@query("SELECT CAST(l_orderkey AS BIGINT) AS call, CAST(l_linenumber AS INT) AS candidate, CAST(cost AS INT) AS cost FROM (SELECT *, l_linenumber % 3 + CAST(l_quantity AS INT) % 5 AS cost, min(l_linenumber % 3 + CAST(l_quantity AS INT) % 5) OVER (PARTITION BY l_orderkey) AS least FROM lineitem WHERE l_linenumber % 2 = l_orderkey % 2) WHERE cost = least")
def best_overloads(s, d):
    li = load(s, d, "lineitem")
    costs = F.array((F.col("l_linenumber") % 3).cast("int"), (F.col("l_quantity").cast("int") % 5).cast("int"))
    c = li.select(F.col("l_orderkey").cast("long").alias("call"), F.col("l_linenumber").cast("int").alias("candidate"), (F.col("l_linenumber") % 2).alias("arity"), (F.col("l_orderkey") % 2).alias("wanted_arity"), costs.alias("costs"))
    return B.best_overloads(c)


@query("SELECT eid FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE source_file <> 'nation.src') AND (is_external OR target_id IN (SELECT id FROM nodes WHERE source_file <> 'nation.src'))", ("nodes", "edges"))
def prune_rows(s, d):
    return B.prune(X.edges(s, d), X.nodes(s, d).where("source_file <> 'nation.src'")).select("eid")


# counts, slices and evidence

@query("SELECT coalesce(a.source_file, b.source_file) AS source_file, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM (SELECT source_file, count(*) AS nodes FROM nodes WHERE label <> 'hub' GROUP BY 1) a FULL JOIN (SELECT source_file, count(*) AS edges FROM edges GROUP BY 1) b USING (source_file)", ("nodes", "edges"))
def file_counts(s, d):
    return D.file_counts(X.nodes(s, d).where("label <> 'hub'"), X.edges(s, d))


@query(None)
def chain_slice_lists(s, d):
    n, e = X.nodes(s, d), X.edges(s, d)
    out = D.chain_block_lists(T.callees(e, _seeds(n), 2), n, e, X.annotations(s, d), by="package")
    return out.select("block", *[F.array_join(c, " ").alias(c) for c in ("methods", "types", "reads", "writes", "annotations", "contexts")], "javadoc")


def _list(c: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ' '), '')"


ORACLE["chain_slice_lists"] = oracle_with("nodes", "edges", "annotations") + _REACH.format(depth=2) + f""", bl AS (SELECT id, coalesce(package, '') AS block, javadoc FROM nodes), cx AS (SELECT DISTINCT source_id, target_id, context FROM edges WHERE relation = 'CALLS'),
t AS (SELECT r.source_id, r.target_id, r.depth, a.block AS sb, b.block AS tb FROM rows r JOIN bl a ON r.source_id = a.id JOIN bl b ON r.target_id = b.id WHERE target_id IS NOT NULL),
m AS (SELECT id, block, min(depth) AS depth FROM (SELECT source_id AS id, sb AS block, depth FROM t UNION ALL SELECT target_id, tb, depth FROM t) GROUP BY 1, 2),
a AS (SELECT block, {_list('id')} AS methods, {_list("split_part(id, '#', 1)")} AS types, arg_min(javadoc, (depth, id)) AS javadoc FROM m JOIN (SELECT id, javadoc FROM bl) USING (id) GROUP BY block),
f AS (SELECT block, {_list("CASE WHEN relation = 'READS' THEN target_id END")} AS reads, {_list("CASE WHEN relation = 'WRITES' THEN target_id END")} AS writes FROM edges JOIN m ON m.id = source_id WHERE relation IN ('READS','WRITES') GROUP BY block),
g AS (SELECT block, {_list('annotation_fqn')} AS annotations FROM annotations JOIN m ON m.id = node_id GROUP BY block), c AS (SELECT sb AS block, {_list('context')} AS contexts FROM t JOIN cx ON t.source_id = cx.source_id AND t.target_id = cx.target_id GROUP BY sb)
SELECT block, methods, types, coalesce(reads, '') AS reads, coalesce(writes, '') AS writes, coalesce(annotations, '') AS annotations, coalesce(contexts, '') AS contexts, javadoc FROM a LEFT JOIN f USING (block) LEFT JOIN g USING (block) LEFT JOIN c USING (block)"""


@query(f"SELECT CAST(sum(occurrence_count) AS BIGINT) AS unresolved FROM ({_DIAG}) WHERE phase LIKE 'resol%'")
def unresolved_sum(s, d):
    return V.unresolved(_diagnostics(s, d))


_FAILURES = """SELECT 'user' || CAST(user_id % 16 AS VARCHAR) || '.src' AS source_file, 'star' AS module, 'MAIN' AS scope, CASE event_id % 3 WHEN 0 THEN 'resolve_call' WHEN 1 THEN 'resolve_type' ELSE 'resolve_field' END AS phase,
CASE event_id % 4 WHEN 0 THEN 'java.util.List' WHEN 1 THEN 'star.Part' WHEN 2 THEN 'org.other.Thing' ELSE event_type END AS symbol, CASE WHEN event_type = 'error' THEN 'Unsupported form' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'Unsolved method x' ELSE '' END AS message, CAST(event_id % 11 AS INT) AS line FROM events"""


@query(f"""WITH g AS (SELECT source_file, module, scope, phase, reason, CASE WHEN reason IN ('INTERNAL','PLATFORM') THEN 'warning' ELSE 'info' END AS severity, symbol, line, count(*) AS occurrences FROM (SELECT *, CASE WHEN message LIKE 'Unsupp%' THEN 'UNSUPPORTED' WHEN phase = 'resolve_field' THEN 'FIELD' WHEN message LIKE 'Unsolved%' THEN 'METHOD'
WHEN symbol LIKE 'java.%' THEN 'PLATFORM' WHEN symbol LIKE 'star.%' THEN 'INTERNAL' WHEN contains(symbol, '.') THEN 'THIRD_PARTY' ELSE 'OTHER' END AS reason FROM ({_FAILURES})) GROUP BY ALL),
k AS (SELECT * FROM g ORDER BY occurrences DESC, source_file, phase, reason, symbol, line, module, scope LIMIT 200)
SELECT * FROM k UNION ALL SELECT NULL, '.', 'MAIN', 'RESOLUTION', 'DIAGNOSTIC_LIMIT_REACHED', 'info', NULL, 0, CAST((SELECT sum(occurrences) FROM g) - (SELECT sum(occurrences) FROM k) AS BIGINT) WHERE (SELECT count(*) FROM g) > 200""")
def failure_buckets(s, d):
    e = load(s, d, "events")
    symbol = F.when(F.col("event_id") % 4 == 0, "java.util.List").when(F.col("event_id") % 4 == 1, "star.Part").when(F.col("event_id") % 4 == 2, "org.other.Thing").otherwise(F.col("event_type"))
    message = F.when(F.col("event_type") == "error", "Unsupported form").when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), "Unsolved method x").otherwise("")
    phase = F.when(F.col("event_id") % 3 == 0, "resolve_call").when(F.col("event_id") % 3 == 1, "resolve_type").otherwise("resolve_field")
    rows = e.select(F.concat(F.lit("user"), (F.col("user_id") % 16).cast("string"), F.lit(".src")).alias("source_file"), F.lit("star").alias("module"), F.lit("MAIN").alias("scope"), phase.alias("phase"), symbol.alias("symbol"), message.alias("message"), (F.col("event_id") % 11).cast("int").alias("line"))
    return V.bounded_failures(rows, 200)


# change

@query("""SELECT CAST(o_orderkey AS VARCHAR) AS source_file, CASE WHEN o_orderkey % 17 = 0 THEN 'deleted' WHEN o_orderkey % 3 = 0 THEN 'same' WHEN o_orderkey % 10 = 0 THEN 'changed' ELSE 'refresh' END AS change FROM orders
UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), 'added' FROM orders WHERE o_orderkey % 13 = 0""")
def file_changes(s, d):
    """A file of equal size and time is taken as the same, changed or not; others by their hash."""
    stat = lambda df, t: df.withColumn("file_size", F.lit(1).cast("long")).withColumn("file_mtime_ns", t)
    none = F.lit(0).cast("long")
    return C.file_changes(stat(_old(s, d), none), stat(_new(s, d), F.when(F.col("o_orderkey") % 3 == 0, none).otherwise(F.lit(5).cast("long"))))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_file, o_orderkey % 10 = 0 AS changed FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), false FROM orders WHERE o_orderkey % 13 = 0")
def incremental_replace_rows(s, d):
    old, new = _old(s, d), _new(s, d)
    changes = C.snapshot_diff(old, new).where("change <> 'same'")
    was = old.select(F.col("source_file").alias("f"), F.col("hash").alias("h"))
    out = C.replace_files(old, new.join(changes, "source_file", "left_semi"), changes)
    return out.join(was, out.source_file == was.f, "left").select("source_file", F.coalesce(F.col("h") != F.col("hash"), F.lit(False)).alias("changed"))


def _edited(n):
    """Suppliers of nation 7 lose their method, regions change their package."""
    kept = n.where("not (kind = 'METHOD' and package <=> 'supply.n7')")
    return kept.withColumn("package", F.when(F.col("label").rlike("^R[0-9]+$") & (F.col("kind") == "CLASS"), "moved").otherwise(F.col("package")))


_REGIONS = "kind = 'CLASS' AND regexp_matches(label, '^R[0-9]+$')"
_TARGETS = f"""SELECT id AS target, 'exact' AS how FROM nodes WHERE (kind = 'METHOD' AND package = 'supply.n7') OR ({_REGIONS}) UNION ALL SELECT id, 'owner' FROM nodes WHERE {_REGIONS} UNION ALL SELECT id, 'implementor' FROM nodes WHERE kind = 'INTERFACE' AND package = 'supply.n7'
UNION ALL SELECT qualified_name, 'external' FROM nodes WHERE {_REGIONS} UNION ALL SELECT qualified_name || '#', 'external_prefix' FROM nodes WHERE {_REGIONS}"""


@query(_TARGETS, ("nodes",))
def symbol_delta_targets(s, d):
    n = X.nodes(s, d)
    return C.delta_targets(n, _edited(n))


@query(None)
def symbol_delta_files(s, d):
    n = X.nodes(s, d)
    return C.files_of_targets(X.edges(s, d), n, C.delta_targets(n, _edited(n)))


ORACLE["symbol_delta_files"] = oracle_with("nodes", "edges") + f""", tg AS ({_TARGETS}), im(id) AS (SELECT source_id FROM edges WHERE NOT is_external AND relation IN ('IMPLEMENTS','INHERITS') AND target_id IN (SELECT target FROM tg WHERE how = 'implementor') UNION SELECT source_id FROM im JOIN edges ON target_id = im.id AND relation IN ('IMPLEMENTS','INHERITS'))
SELECT DISTINCT source_file FROM (SELECT source_file FROM edges WHERE NOT is_external AND (target_id IN (SELECT target FROM tg WHERE how = 'exact') OR split_part(target_id, '#', 1) IN (SELECT target FROM tg WHERE how = 'owner'))
UNION ALL SELECT source_file FROM nodes WHERE id IN (SELECT id FROM im)) WHERE source_file IS NOT NULL"""


@query("SELECT id, 'family' AS change FROM nodes WHERE kind = 'METHOD' AND package = 'supply.n7'", ("nodes",))
def overload_family(s, d):
    n = X.nodes(s, d)
    gone = C.symbol_delta(n, n.where("not (kind = 'METHOD' and package <=> 'supply.n7')"))
    return C.overload_family(gone, n).select("id", F.lit("family").alias("change"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def published_version(s, d):
    """Two versions are written; readers get the second."""
    v = C.Versions(s, scratch(s, "versions"))
    nation = load(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    v.write({"nation": nation})
    v.write({"nation": nation.where("n_regionkey <> 2")})
    return v.read("nation").select("n_nationkey", "n_name")


# streams

def _streamed(s, d, aggregated):
    """The last state of an aggregate over the events as a stream, with its watermark at work."""
    from graphloom.streaming import changes as R

    out = scratch(s, "aggregate")
    R.run_aggregate(aggregated(_event_stream(s, d)), out, scratch(s, "stream"))
    df = s.read.parquet(out)
    # streams need times with a zone; the tables have none
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query(ORACLE["stream_session_debounce"])
def stream_session_live(s, d):
    from graphloom.streaming import changes as R

    return _streamed(s, d, lambda e: R.debounced(e, "ts", "user_id", "30 minutes"))


@query(ORACLE["stream_windows"])
def stream_windows_live(s, d):
    from graphloom.streaming import changes as R

    return _streamed(s, d, lambda e: R.tumbling(e, "ts", "event_type")).withColumn("total", F.round("total", 4))
