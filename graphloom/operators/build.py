"""Fact construction: reference resolution, re-binding, pruning, wiring, flow linking, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identity import arity_key, doc_summary, owner_of
from graphloom.storage import cut


def resolve_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a symbol as target_id, bound to storage keys. Candidates of the symbol are judged
    in five tiers (same file; same module and scope; same module's MAIN; any MAIN; any); the first
    tier with exactly one candidate binds. An edge that none binds becomes external and AMBIGUOUS.
    One join on the symbol and one aggregate serve all tiers."""
    c = nodes.select(F.col("symbol_id").alias("target_id"), F.col("id").alias("cid"), F.col("source_file").alias("cf"), F.col("module").alias("cm"), F.col("scope").alias("cs"))
    src = nodes.select(F.col("id").alias("source_id"), F.col("module").alias("sm"), F.col("scope").alias("ss"))
    own = edges.join(src, "source_id", "left")
    asked = own.select("eid", "target_id", "source_file", "sm", "ss").where("target_id is not null")
    m = asked.join(c, "target_id")
    tiers = [F.col("cf") == F.col("source_file"), (F.col("cm") == F.col("sm")) & (F.col("cs") == F.col("ss")), (F.col("cm") == F.col("sm")) & (F.col("cs") == "MAIN"), F.col("cs") == "MAIN", F.lit(True)]
    agg = [x for i, t in enumerate(tiers) for x in (F.count_if(t).alias(f"n{i}"), F.min(F.when(t, F.col("cid"))).alias(f"b{i}"))]
    bound = m.groupBy("eid").agg(*agg).select("eid", F.coalesce(*[F.when(F.col(f"n{i}") == 1, F.col(f"b{i}")) for i in range(5)]).alias("bound"))
    out = own.join(bound, "eid", "left")
    lost = F.col("target_id").isNotNull() & F.col("bound").isNull()
    return out.select(*[
        {
            "target_id": F.col("bound"), "external_target_fqn": F.when(lost, F.col("target_id")).otherwise(F.col("external_target_fqn")),
            "confidence": F.when(lost, F.lit("AMBIGUOUS")).otherwise(F.col("confidence")), "is_external": F.col("bound").isNull(),
        }.get(c, F.col(c)).alias(c)
        for c in edges.columns
    ])


def rebind_external(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """External edges whose name is a node after all become internal: by exact id, by the only node
    of that symbol ($ as . for reflection), by the only node of that name and arity. Names are bound
    once each, and edges meet them in one join."""
    ext, rest = edges.where("is_external"), edges.where("not is_external")
    name = F.when(F.col("resolution") == "reflection", F.translate("external_target_fqn", "$", ".")).otherwise(F.col("external_target_fqn"))
    names = ext.select("external_target_fqn", name.alias("__n")).distinct().withColumn("__a", F.when(F.col("__n").endswith(")"), arity_key(F.col("__n"))))
    by_id = nodes.select(F.col("id").alias("external_target_fqn"), F.col("id").alias("b1"))
    by_symbol = nodes.groupBy(F.col("symbol_id").alias("__n")).agg(F.count("*").alias("k"), F.min("id").alias("b2")).where("k = 1").drop("k")
    by_arity = nodes.where(F.col("symbol_id").endswith(")")).groupBy(arity_key(F.col("symbol_id")).alias("__a")).agg(F.count("*").alias("k"), F.min("id").alias("b3")).where("k = 1").drop("k")
    found = names.join(by_id, "external_target_fqn", "left").join(by_symbol, "__n", "left").join(by_arity, "__a", "left").select("external_target_fqn", "__n", F.coalesce("b1", "b2", "b3").alias("bound")).where("bound is not null")
    j = ext.withColumn("__n", name).join(found, ["external_target_fqn", "__n"], "left")
    hit = F.col("bound").isNotNull()
    bound = j.select(*[{"target_id": F.col("bound"), "external_target_fqn": F.when(~hit, F.col("external_target_fqn")), "is_external": ~hit, "resolution": F.when(~hit, F.col("resolution"))}.get(c, F.col(c)).alias(c) for c in edges.columns])
    return rest.unionByName(bound)


def backfill_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a file take their source node's."""
    files = nodes.select(F.col("id").alias("source_id"), F.col("source_file").alias("__f"))
    return edges.join(files, "source_id", "left").withColumn("source_file", F.coalesce("source_file", "__f")).select(*edges.columns)


def prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source, and whose target if internal, exist."""
    lost = _lost(edges, nodes)
    out = edges.where("source_id is not null and (is_external or target_id is not null)").join(lost.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    # an external edge's target is not looked up
    inner = lost.select(F.col("id").alias("__t"))
    return out.withColumn("__t", F.when(~F.col("is_external"), F.col("target_id"))).where("is_external is not null").join(inner, "__t", "left_anti").select(*edges.columns)


def _lost(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no nodes, each once. They are few where facts are sound, so that
    edges needn't be sent to where all the nodes are, twice."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.where("not is_external").select(F.col("target_id").alias("id"))).where("id is not null").distinct()
    return cut(ends.join(nodes.select("id"), "id", "left_anti"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(relation, n): how many edges prune() drops."""
    a = edges.groupBy("relation").agg(F.count("*").alias("a"))
    b = prune(edges, nodes).groupBy("relation").agg(F.count("*").alias("b"))
    return a.join(b, "relation", "left").select("relation", (F.col("a") - F.coalesce("b", F.lit(0))).alias("n")).where("n > 0")


def wire(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, confidence, via): each owner that has an interface injected
    is wired to what implements it, INFERRED if there is one, else AMBIGUOUS; edges already there
    are left out, nulls being equal."""
    inj = edges.where("relation = 'INJECTS' and not is_external").select(F.col("source_id").alias("owner"), F.col("target_id").alias("iface")).distinct()
    impl = edges.where("relation = 'IMPLEMENTS' and not is_external").select(F.col("target_id").alias("iface"), F.col("source_id").alias("impl")).distinct()
    impl = impl.withColumn("n", F.count("*").over(Window.partitionBy("iface")))
    # owner and implementation may meet at several interfaces: each side brings all of its own, and
    # the pair counts at the first that both have, so that pairs needn't be shuffled to find repeats
    inj = inj.where("iface is not null").withColumn("wanted", F.collect_list("iface").over(Window.partitionBy("owner")))
    impl = impl.where("iface is not null").withColumn("given", F.collect_list(F.struct("iface", "n")).over(Window.partitionBy("impl")))
    both = F.filter("given", lambda g: F.array_contains("wanted", g["iface"]))
    made = inj.join(impl, "iface").withColumn("both", both).where(F.col("iface") == F.array_min(F.transform("both", lambda g: g["iface"])))
    sure = F.forall("both", lambda g: g["n"] == 1)
    one = made.select(F.col("owner").alias("source_id"), F.col("impl").alias("target_id"), F.lit("WIRES").alias("relation"), F.when(sure, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), F.lit("injection").alias("via"))
    have = edges.where("relation = 'WIRES'").select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    return one.join(have, one.source_id.eqNullSafe(have.s) & one.target_id.eqNullSafe(have.t), "left_anti").select("source_id", "target_id", "relation", "confidence", "via")


def injected_calls(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, confidence): calls to a method of an injected interface, repeated for
    each method that overrides it."""
    inj = edges.where("relation = 'INJECTS' and not is_external").select(F.col("source_id").alias("ot"), F.col("target_id").alias("it")).distinct()
    calls = edges.where("relation = 'CALLS' and not is_external").select("source_id", F.col("target_id").alias("im")).distinct()
    calls = calls.withColumn("ot", owner_of(F.col("source_id"))).withColumn("it", owner_of(F.col("im")))
    over = edges.where("relation = 'OVERRIDES' and not is_external").select(F.col("target_id").alias("im"), F.col("source_id").alias("impl")).distinct().withColumn("n", F.count("*").over(Window.partitionBy("im")))
    made = calls.join(inj, ["ot", "it"]).join(over, "im").select("source_id", F.col("impl").alias("target_id"), F.when(F.col("n") == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"))
    have = edges.where("relation = 'CALLS' and not is_external").select("source_id", "target_id")
    return made.join(have, ["source_id", "target_id"], "left_anti").distinct()


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_file, depends_on_file): distinct pairs of different files that internal edges join."""
    f = nodes.where("source_file is not null").select("id", "source_file")
    pairs = edges.where("not is_external").select("source_id", "target_id")
    s, t = f.select(F.col("id").alias("source_id"), "source_file"), f.select(F.col("id").alias("target_id"), F.col("source_file").alias("depends_on_file"))
    return pairs.join(s, "source_id").select("source_file", "target_id").distinct().join(t, "target_id").where("source_file <> depends_on_file").select("source_file", "depends_on_file").distinct()


def unique_callees(flow_calls: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, callee_method): flow calls (id, method_id, label, line) bound to the only callee of that
    name that the method calls at that line."""
    calls = edges.where("relation = 'CALLS' and not is_external").select(F.col("source_id").alias("method_id"), F.col("target_id").alias("callee"), F.regexp_extract("source_location", "L([0-9]+)", 1).cast("int").alias("line"))
    named = calls.join(nodes.select(F.col("id").alias("callee"), "label"), "callee")
    return flow_calls.join(named, ["method_id", "label", "line"]).groupBy("id").agg(F.countDistinct("callee").alias("k"), F.min("callee").alias("callee_method")).where("k = 1").select("id", "callee_method")


def link_flow(flow_nodes: DataFrame) -> DataFrame:
    """(source_node, target_node, relation, context): flow between methods. Arguments reach the
    callee's parameter of the same slot, returns reach the call's result, thrown exceptions too."""
    results = flow_nodes.where("kind = 'CALL_RESULT' and callee_method is not null").select(F.col("id").alias("call"), "callee_method")
    args = flow_nodes.where("kind = 'EXPRESSION' and callee_method is not null and slot is not null").select(F.col("id").alias("arg"), "callee_method", "slot")
    of = lambda kind: flow_nodes.where(F.col("kind").isin(*kind)).select(F.col("id").alias("n"), F.col("method_id").alias("callee_method"), "slot")
    a = args.join(of(("PARAMETER",)), ["callee_method", "slot"]).select(F.col("arg").alias("source_node"), F.col("n").alias("target_node"), F.lit("CALL_ARGUMENT").alias("relation"), F.col("slot").alias("context"))
    r = results.join(of(("RETURN",)).drop("slot"), "callee_method").select(F.col("n").alias("source_node"), F.col("call").alias("target_node"), F.lit("CALL_RETURN").alias("relation"), F.lit(None).cast("string").alias("context"))
    x = results.join(of(("THROW",)).drop("slot"), "callee_method").select(F.col("n").alias("source_node"), F.col("call").alias("target_node"), F.lit("EXCEPTION_FLOW").alias("relation"), F.lit("callee").alias("context"))
    return a.unionByName(r).unionByName(x)


def flow_summaries(flow_nodes: DataFrame, flow_edges: DataFrame, visits: int = 50_000) -> DataFrame:
    """(method_id, input_slot, output_slot, relation): which parameters of a method reach its returns
    and throws. A method's flow is small and stays together; at most visits nodes are looked at."""
    import pandas as pd

    e = flow_edges.select("method_id", F.col("source_node").alias("a"), F.col("target_node").alias("b"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("slot"))
    n = flow_nodes.where("kind in ('PARAMETER', 'RETURN', 'THROW')").select("method_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "kind", "slot")

    def reach(part: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in part[part.b.notna()][["a", "b"]].itertuples(index=False):
            after.setdefault(a, []).append(b)
        ends = {r.a: r for r in part[part.kind.isin(["RETURN", "THROW"])].itertuples()}
        rows, left = set(), visits
        for p in part[part.kind == "PARAMETER"].sort_values("a").itertuples():
            todo, seen = [p.a], {p.a}
            while todo and left > 0:
                x, left = todo.pop(), left - 1
                if x in ends:
                    rows.add((part.method_id.iloc[0], f"arg:{p.slot}", "return" if ends[x].kind == "RETURN" else "throw", "DEF_USE"))
                for y in after.get(x, []):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return pd.DataFrame(sorted(rows), columns=["method_id", "input_slot", "output_slot", "relation"])

    return e.unionByName(n).groupBy("method_id").applyInPandas(reach, "method_id string, input_slot string, output_slot string, relation string")


def derive_overrides(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(source_id, target_id): methods (id, owner, signature) and those of the same signature that an
    ancestor (type, ancestor) of their owner has."""
    above = methods.select(F.col("id").alias("target_id"), F.col("owner").alias("ancestor"), "signature")
    own = methods.select(F.col("id").alias("source_id"), F.col("owner").alias("type"), "signature")
    return own.join(ancestors, "type").join(above, ["ancestor", "signature"]).select("source_id", "target_id").distinct()


def best_overloads(candidates: DataFrame) -> DataFrame:
    """Of (call, candidate, arity, wanted_arity, costs) the candidates of the right arity with the
    least sum of argument costs; ties all stay."""
    right = candidates.where("arity = wanted_arity").withColumn("cost", F.aggregate("costs", F.lit(0), lambda a, x: a + x))
    return right.withColumn("least", F.min("cost").over(Window.partitionBy("call"))).where("cost = least").select("call", "candidate", "cost")


def doc_annotations(nodes: DataFrame) -> DataFrame:
    """(node_id, business_description, source, confidence): first sentences of documentation."""
    return nodes.where("javadoc is not null and trim(javadoc) <> ''").select(F.col("id").alias("node_id"), doc_summary(F.col("javadoc")).alias("business_description"), F.lit("JAVADOC").alias("source"), F.lit("MEDIUM").alias("confidence"))


def last_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row a key, the one with the greatest order, by a partial aggregate and no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
