"""Queries for what reads files and settings, watches them, and puts answers together."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom.functions import identity as I
from graphloom.operators import build as B
from graphloom.operators import change as C
from graphloom.operators import enrich as E
from graphloom.operators import evidence as V
from graphloom.operators import lookup as L
from graphloom.operators import search as S
from graphloom.operators import traverse as T
from graphloom.plans import output
from graphloom.plans.catalog import _DIAG, _MEM, _PDEPS, _REACH, _SEEDS, _TALLY, ORACLE, _diagnostics, _new, _old, _segment, query
from graphloom.sources import files as W
from graphloom.sources import tables as X
from graphloom.sources.tables import load, oracle_with
from graphloom.storage import scratch
from graphloom.streaming.watch import Watch


def _put(s, root: str, texts: dict[str, str]) -> str:
    """Writes a few small files below root."""
    at = s._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(s._jsc.hadoopConfiguration())
    for name, text in texts.items():
        stream = fs.create(at(f"{root}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
    return root


# files

@query("SELECT 'N' || CAST(n_nationkey AS VARCHAR) || '.java' AS source_file, sha256('class ' || n_name || ' {}') AS hash, CAST(strlen('class ' || n_name || ' {}') AS BIGINT) AS file_size FROM nation WHERE n_regionkey <> 1")
def source_scan(s, d):
    """A tree of one file for each nation; those below gen are excluded."""
    rows = load(s, d, "nation").collect()
    texts = {f"{'gen/' if r.n_regionkey == 1 else ''}N{r.n_nationkey}.java": f"class {r.n_name} {{}}" for r in rows}
    return W.source_files(s, _put(s, scratch(s, "tree"), texts), excludes=["gen/*"]).select("source_file", "hash", "file_size")


@query("SELECT 'docs/R' || CAST(r_regionkey AS VARCHAR) || '.md' AS path, r_name AS title, 'DOC' AS doc_type, 'docs' AS module FROM region UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR) || '/README.md', 'README', 'README', 'N' || CAST(n_nationkey AS VARCHAR) FROM nation")
def markdown_scan(s, d):
    texts = {f"docs/R{r.r_regionkey}.md": f"intro\n# {r.r_name}\n\nmore" for r in load(s, d, "region").collect()}
    texts |= {f"N{r.n_nationkey}/{name}.md": "no heading" for r in load(s, d, "nation").collect() for name in ("README", "CHANGELOG")}
    return W.documents(s, _put(s, scratch(s, "docs"), texts)).select("path", "title", "doc_type", "module")


@query("""SELECT b AS source_id, NULL AS target_id, 'catalog.T' || k AS external_target_fqn, 'DEFINED_BY' AS relation FROM (SELECT CAST(p_partkey AS VARCHAR) AS k, 'bean:T' || CAST(p_partkey AS VARCHAR) || '@T' || CAST(p_partkey AS VARCHAR) || '.xml' AS b FROM part)
UNION ALL SELECT b, b || '/property[0]', NULL, 'CONFIGURES' FROM (SELECT 'bean:T' || CAST(p_partkey AS VARCHAR) || '@T' || CAST(p_partkey AS VARCHAR) || '.xml' AS b FROM part)
UNION ALL SELECT b || '/property[0]', 'bean:T' || up || f, NULL, 'XML_REFERS_TO' FROM (SELECT 'bean:T' || CAST(p_partkey AS VARCHAR) || '@T' || CAST(p_partkey AS VARCHAR) || '.xml' AS b, CAST(p_partkey // 2 AS VARCHAR) AS up, '@T' || CAST(p_partkey AS VARCHAR) || '.xml' AS f FROM part)""")
def bean_xml_scan(s, d):
    """A bean file for each part, that refers to the part of half its number."""
    k = F.col("p_partkey").cast("string")
    up = F.floor(F.col("p_partkey") / 2).cast("string")
    content = F.concat(F.lit('<beans><bean id="T'), k, F.lit('" class="catalog.T'), k, F.lit('"><property name="up" ref="T'), up, F.lit('"/></bean></beans>'))
    _, edges = W.xml_beans(load(s, d, "part").select(F.concat(F.lit("T"), k, F.lit(".xml")).alias("source_file"), content.alias("content")))
    return edges.select("source_id", "target_id", "external_target_fqn", "relation")


@query("SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS business_label, 'DOC' AS source FROM nation")
def annotation_scan(s, d):
    rows = [{"id": str(r.n_nationkey), "node_id": f"N{r.n_nationkey}", "business_label": r.n_name, "source": "DOC", "confidence": "HIGH"} for r in load(s, d, "nation").collect()]
    root = _put(s, scratch(s, "batch"), {"batch.json": json.dumps(rows)})
    return W.annotation_batch(s, f"{root}/batch.json").select("node_id", "business_label", "source")


@query("SELECT id, CASE WHEN label LIKE 'sign%' THEN 'TAINT_SOURCE' WHEN label = 'purchase' THEN 'TAINT_SINK' WHEN label LIKE 'err_r' THEN 'SANITIZER' END AS taint FROM fnodes", ("fnodes",))
def taint_classes(s, d):
    root = _put(s, scratch(s, "rules"), {"rules.json": json.dumps({"sources": ["sign*"], "sinks": ["purchase"], "sanitizers": ["err?r"]})})
    return W.classify(X.flow_nodes(s, d), W.taint_rules(f"{root}/rules.json", s), "label").select("id", "taint")


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE n_regionkey = 2")
def settings_scan(s, d):
    """A TOML file says which region is asked for."""
    root = _put(s, scratch(s, "settings"), {"graph.toml": "[scope]\nregion = 2\n"})
    region = W.settings(f"{root}/graph.toml", s)["scope"]["region"]
    return load(s, d, "nation").where(F.col("n_regionkey") == region).select("n_nationkey", F.col("n_name").alias("name"))


@query("SELECT id FROM nodes WHERE package LIKE 'supply.n1%' OR source_file LIKE 'nation.%' OR qualified_name LIKE '%R2#hub'", ("nodes",))
def flow_scope_nodes(s, d):
    return W.flow_scope(X.nodes(s, d), ["package:supply.n1*", "source:nation.*", "method:*R2#hub"]).select("id")


@query("SELECT 'doc' || CAST(doc_id AS VARCHAR) AS id, lang AS label FROM documents")
def analyzer_nodes(s, d):
    @output.analyzer("documents")
    def facts(docs):
        nodes = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("label"), F.lit("DOCUMENT").alias("kind"))
        return nodes, nodes.select(F.col("id").alias("source_id"), F.col("label").alias("external_target_fqn"), F.lit("REFERENCES").alias("relation"))

    return output.ANALYZERS["documents"](load(s, d, "documents"))[0].select("id", "label")


@query("SELECT id, split_part(id, '::', 3) AS symbol, 'a%3Ab%25::TEST::' || symbol_id AS other, CASE WHEN kind = 'METHOD' THEN split_part(symbol_id, '(', 1) || CASE WHEN symbol_id LIKE '%()' THEN '/0' ELSE '/1' END END AS arity FROM nodes", ("nodes",))
def identity_rewrite(s, d):
    """Extractor symbols to storage keys and back, and the keys by arity."""
    key = I.storage_key(F.col("module"), F.col("scope"), F.col("symbol_id"))
    other = I.storage_key(F.lit("a:b%"), F.lit("TEST"), F.col("symbol_id"))
    return X.nodes(s, d).select(key.alias("id"), I.symbol_of(key).alias("symbol"), other.alias("other"), F.when(F.col("kind") == "METHOD", I.arity_key(F.col("symbol_id"))).alias("arity"))


# answers

@query("SELECT id, label, (SELECT count(*) FROM nodes WHERE kind = 'INTERFACE') AS total, CASE WHEN (SELECT count(*) FROM nodes WHERE kind = 'INTERFACE') > 9 THEN 'suppliers --offset 9' END AS next_query FROM nodes WHERE kind = 'INTERFACE' ORDER BY id LIMIT 4 OFFSET 5", ("nodes",))
def envelope_page(s, d):
    """A page of the suppliers as JSON, and read again."""
    own = X.nodes(s, d).where("kind = 'INTERFACE'")
    info = L.page_info(own.count(), 4, 5)
    text = output.envelope({"command": "suppliers"}, L.page(own, ["id"], 4, 5).select("id", "label"), info, {"status": "found"}, output.follow_ups("suppliers", info))
    got = json.loads(text)
    following = (got["next_queries"] or [None])[0]
    return s.createDataFrame([(r["id"], r["label"], got["stats"]["total"], following) for r in got["results"]], "id string, label string, total long, next_query string")


@query(f"""WITH t AS (SELECT 3 AS part, package AS k, '| ' || package || ' | ' || CAST(types AS VARCHAR) || ' | ' || CAST(methods AS VARCHAR) || ' |' AS text FROM ({_TALLY.replace('FROM nodes', 'FROM (' + oracle_with('nodes') + ' SELECT * FROM nodes)')}) ORDER BY package LIMIT 30)
SELECT CAST(row_number() OVER (ORDER BY part, k) AS INT) AS line, text FROM (VALUES (0, '0', '# Packages'), (0, '1', ''), (0, '2', '## tallies'), (0, '3', ''), (1, '0', '| package | types | methods |'), (2, '0', '|---|---|---|'), (4, '0', ''), (4, '1', '(more rows left out)'), (4, '2', '')) AS v(part, k, text) FULL JOIN t USING (part, k, text)""")
def markdown_packages(s, d):
    """The first thirty packages as a Markdown view, by lines."""
    from graphloom.operators import dependency as D

    text = output.markdown("Packages", {"tallies": D.package_tallies(X.nodes(s, d)).orderBy("package")})
    return s.createDataFrame(list(enumerate(text.split("\n"), 1)), "line int, text string")


@query("SELECT round(sum(CASE WHEN i = 1 THEN pow(0.75, n - 1) ELSE 0.25 * pow(0.75, n - i) END * v), 6) AS cost, count(*) <= 200 AS worth FROM (SELECT n_nationkey AS v, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS n FROM nation)")
def cost_history(s, d):
    values = [float(r.n_nationkey) for r in load(s, d, "nation").orderBy("n_nationkey").collect()]
    return s.createDataFrame([(round(V.ewma(values), 6), V.worth_increment(len(values), 30))], "cost double, worth boolean")


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events WHERE user_id = 7) SELECT asked, CASE WHEN (SELECT n FROM n) = 0 AND asked IN (1, 4, 5) THEN 'FLOW_ENDPOINT_UNKNOWN' ELSE outcome END AS outcome
FROM (VALUES (1, 'u7'), (2, 'FLOW_ENDPOINT_AMBIGUOUS'), (3, 'FLOW_ENDPOINT_UNKNOWN'), (4, 'FLOW_SLOT_REQUIRED'), (5, 'FLOW_COVERAGE_MISSING')) AS v(asked, outcome)""")
def endpoint_gates(s, d):
    n = X.flow_nodes(s, d).select("method_id").distinct()
    full = n.select("method_id", F.lit("DETAIL").alias("detail_level"))
    one = n.where("method_id = 'u7'")
    asked = [(one, full, False), (n, full, False), (n.where("method_id = 'nobody'"), full, False), (one, full, True), (one, full.withColumn("detail_level", F.lit("SUMMARY")), False)]
    out = []
    for k, (methods, coverage, slot) in enumerate(asked, 1):
        try:
            out.append((k, T.flow_endpoint(methods, coverage, need_slot=slot)))
        except (ValueError, LookupError) as x:
            out.append((k, str(x).split(":")[0]))
    return s.createDataFrame(out, "asked int, outcome string")


@query(None)
def enrich_segment(s, d):
    """All that is known of the customers of one nation, with three documents."""
    n, e = X.nodes(s, d), X.edges(s, d, "CALLS", "CONTAINS", "OVERRIDES", "INJECTS")
    best = S.related_documents(load(s, d, "documents"), "doc_id", ["text"], "thing under", 3, "text").select(F.col("doc_id").alias("id"), "snippet")
    said = B.doc_annotations(n).select("node_id", "business_description")
    return E.enriched(_segment(n), n, e, X.annotations(s, d), said, best)


ORACLE["enrich_segment"] = f"""SELECT section, id, detail FROM ({ORACLE['context_members']}) UNION ALL SELECT * FROM ({oracle_with('nodes', 'edges')}{_REACH.format(depth=1).replace(_SEEDS, _MEM)} SELECT DISTINCT 'callee', source_id, relation || ' ' || coalesce(target_id, external_target_fqn) FROM rows)
UNION ALL SELECT 'semantic', id, regexp_extract(javadoc, '^(.*?\\.)( |$)', 1) FROM ({oracle_with('nodes', 'edges')} SELECT * FROM nodes WHERE javadoc IS NOT NULL AND id IN {_MEM})
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), snippet FROM (SELECT doc_id, substr(text, 1, 200) AS snippet FROM ({ORACLE['rank_documents']}) r JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 3)"""


@query(f"""SELECT (SELECT count(DISTINCT package) FROM nodes) AS packages, (SELECT count(*) FROM nodes WHERE kind IN ('CLASS','INTERFACE')) AS types, (SELECT count(*) FROM nodes WHERE kind = 'METHOD') AS methods,
(SELECT count(*) FROM (SELECT DISTINCT source_package, target_package FROM ({_PDEPS}))) AS dependencies, (SELECT array_to_string(list_sort(list(DISTINCT code)), ',') FROM ({_DIAG}) WHERE severity = 'error') AS blocking, 'BLOCKED' AS status""", ("nodes", "edges"))
def survey_baseline(s, d):
    meta = s.createDataFrame([("project", "star")], "key string, value string")
    return E.baseline(X.nodes(s, d), X.edges(s, d), _diagnostics(s, d), meta, "star").withColumn("blocking", F.array_join("blocking", ","))


# versions and the watch

@query("SELECT 'nodes' AS part, count(*) AS n FROM nodes UNION ALL SELECT 'flow_nodes', count(*) FROM fnodes UNION ALL SELECT 'flow_edges', count(*) FROM fedges UNION ALL SELECT 'documents', count(*) FROM documents", ("nodes", "fnodes", "fedges"))
def published_facts(s, d):
    """Graph, flow and documents as one version, as readers get it."""
    v = C.Versions(s, scratch(s, "facts"))
    parts = {"nodes": X.nodes(s, d), "flow_nodes": X.flow_nodes(s, d), "flow_edges": X.flow_edges(s, d), "documents": load(s, d, "documents")}
    v.write(parts)
    out = [v.read(name).agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _watched(s, d, events):
    """(watch, folder that changes were applied to, versions that a rebuild publishes)."""
    done, versions = scratch(s, "applied"), C.Versions(s, scratch(s, "rebuilt"))
    watch = Watch(s, scratch(s, "watch"), lambda: _stat(_new(s, d)), lambda: _stat(_old(s, d)), lambda changes: changes.write.mode("overwrite").parquet(done), lambda: versions.write({"files": _new(s, d)}))
    watch.step(events)
    watch.settle(wait=True)
    return watch, done, versions


def _stat(files):
    return files.withColumn("file_size", F.lit(1).cast("long")).withColumn("file_mtime_ns", F.lit(0).cast("long"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_file, CASE WHEN o_orderkey % 17 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 10 = 0")
def watch_changes(s, d):
    """Events name every file that the graph has, of which the watch redoes those that differ."""
    events = load(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("MODIFY").alias("kind"))
    return s.read.parquet(_watched(s, d, events)[1]).select("source_file", "change")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS source_file, 'REBUILDING IDLE' AS states FROM orders WHERE o_orderkey % 17 <> 0 UNION ALL SELECT 'n' || CAST(o_orderkey AS VARCHAR), 'REBUILDING IDLE' FROM orders WHERE o_orderkey % 13 = 0")
def watch_overflow(s, d):
    """Events were lost: all files are compared, too many differ, and a rebuild publishes all anew."""
    watch, _, versions = _watched(s, d, s.createDataFrame([(None, "OVERFLOW")], "path string, kind string"))
    states = " ".join(x["state"] for x in watch.state.history())
    return versions.read("files").select("source_file", F.lit(states).alias("states"))


# states

@query("SELECT method_id, min(line) AS line FROM fnodes GROUP BY method_id", ("fnodes",))
def keep_one(s, d):
    """The first flow node of each method."""
    return L.keep_first(X.flow_nodes(s, d), ["method_id"], ["line"]).select("method_id", "line")


@query(f"SELECT 12 AS version, CASE WHEN (SELECT count(*) FROM nodes) = 0 THEN 'INDEX_EMPTY ' ELSE '' END || CASE WHEN (SELECT count(*) FROM ({_DIAG}) WHERE phase = 'parse' AND severity = 'error') > 0 THEN 'PARSE_INCOMPLETE' ELSE '' END AS blockers, 'DEGRADED' AS status UNION ALL SELECT 11, 'SCHEMA_MISMATCH INDEX_STALE', 'REPAIR_REQUIRED'", ("nodes",))
def readiness_report(s, d):
    """Whether the graph may be relied on, by its size and its diagnostics: tables of this schema, and
    tables of the one before that are stale."""
    worst = {r.phase: r.worst for r in V.health(_diagnostics(s, d)).collect()}
    states = {p: ("complete", "partial", "failed")[w] for p, w in worst.items()} | {"resolution": "partial" if any(p.startswith("resol") and w for p, w in worst.items()) else "complete"}
    n = X.nodes(s, d).count()
    out = [(v, V.readiness(v, 12, n, v < 12, states)) for v in (12, 11)]
    return s.createDataFrame([(v, " ".join(r["blockers"]), r["status"]) for v, r in out], "version int, blockers string, status string")
