"""Level-by-level traversal of calls with dispatch bridging, shortest paths and flow paths.

Each level is one set of joins on the frontier; levels are written to the shared folder, which cuts
the plan and survives lost executors. The adjacency is projected once to the columns a level needs.
Only counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identity import enclosing_method
from graphloom.operators.sieve import semi
from graphloom.schema import BODY_KINDS, DATA_FLOW
from graphloom.storage import cut

MAX_DEPTH = 20
ROW = ["source_id", "target_id", "external_target_fqn", "relation", "call_kind", "confidence", "context", "source_location"]


def depth_of(asked: int, default: int = 1, most: int = MAX_DEPTH) -> int:
    return min(max(1, asked if asked > 0 else default), most)


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'CALLS'").select(*ROW)


def _overrides(edges: DataFrame, once: bool = True) -> DataFrame:
    """(iface, impl)."""
    pairs = edges.where("relation = 'OVERRIDES' and not is_external").select(F.col("target_id").alias("iface"), F.col("source_id").alias("impl"))
    return pairs.distinct() if once else pairs


def _bridge(pairs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return pairs.select(F.col("iface").alias("source_id"), F.col("impl").alias("target_id"), none.alias("external_target_fqn"), F.lit("OVERRIDES").alias("relation"), none.alias("call_kind"), F.lit("INFERRED").alias("confidence"), none.alias("context"), none.alias("source_location"))


def _once(rows: DataFrame) -> DataFrame:
    """One row for each (source, target, depth, relation, location, reflection or not)."""
    key = [F.col("source_id"), F.coalesce("target_id", "external_target_fqn"), F.col("depth"), F.col("relation"), F.col("source_location"), F.coalesce(F.col("call_kind") == "REFLECTION", F.lit(False))]
    rest = [c for c in rows.columns if c not in ("source_id", "depth", "relation", "source_location")]
    best = rows.groupBy(F.col("source_id"), key[1].alias("__t"), F.col("depth"), F.col("relation"), F.col("source_location"), key[5].alias("__r")).agg(F.min(F.struct(*rest)).alias("__b"))
    return best.select("source_id", "depth", "relation", "source_location", *[F.col(f"__b.{c}").alias(c) for c in rest]).select(*rows.columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def callback_bodies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(outer, body): anonymous classes, lambdas, method references and the methods within them, by
    containment below each real method, however deep. Containment is a tree, so pairs don't repeat;
    where it isn't, a pair comes once."""
    inner = nodes.where(F.col("kind").isin(*BODY_KINDS) | F.col("id").contains("$anon@") | F.col("id").contains("$lambda@")).select(F.col("id").alias("body"))
    holds = edges.where("relation = 'CONTAINS' and not is_external").select(F.col("source_id").alias("above"), F.col("target_id").alias("body")).join(inner, "body", "left_semi")
    real = nodes.where("kind = 'METHOD'").where(~F.col("id").contains("$anon@") & ~F.col("id").contains("$lambda@")).select(F.col("id").alias("above"))
    holds = cut(holds)
    level = cut(holds.join(real, "above", "left_semi").select(F.col("above").alias("outer"), "body").distinct())
    out = [level]
    while not level.isEmpty():
        below = level.withColumnRenamed("body", "above").join(holds, "above").select("outer", "body").distinct()
        level = cut(below.join(_union(out), ["outer", "body"], "left_anti"))
        out.append(level)
    return _union(out)


def with_callbacks(calls: DataFrame, bodies: DataFrame) -> DataFrame:
    """Calls, and those made within callback bodies as calls of the outer method, via the body."""
    own = calls.withColumn("via", F.lit(None).cast("string"))
    inner = calls.withColumnRenamed("source_id", "body").join(bodies, "body")
    inner = inner.withColumn("source_id", F.col("outer")).withColumn("via", F.col("body")).withColumn("call_kind", F.coalesce("call_kind", F.lit("CALLBACK"))).select(*own.columns)
    return own.unionByName(inner)


def callees(edges: DataFrame, seeds: DataFrame, depth: int = 1, bodies: DataFrame | None = None) -> DataFrame:
    """Edges met going out from seeds (id), with the depth of each. Edges into known nodes are given
    but not followed, external targets neither. For each node reached or expanded, the edges to the
    methods that override it are given as OVERRIDES, and followed."""
    rows, _ = _callees(edges, seeds, depth, bodies)
    return _once(rows)


def called(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(source_id, relation, target) of the callees, each once; external targets by their names."""
    rows, _ = _callees(edges, seeds, depth, None)
    return rows.select("source_id", "relation", F.coalesce("target_id", "external_target_fqn").alias("target")).distinct()


def callees_frontier(edges: DataFrame, seeds: DataFrame, depth: int = 1, bodies: DataFrame | None = None) -> DataFrame:
    """(frontier_count): owners that have edges beyond the depth."""
    _, last = _callees(edges, seeds, depth, bodies)
    calls, last = _calls(edges), cut(last)
    more = calls.join(last.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    able = last.unionByName(more.where("target_id is not null").select(F.col("target_id").alias("id"))).distinct()
    owners = more.select(F.col("source_id").alias("id")).unionByName(_overrides(edges).select(F.col("iface").alias("id")).join(able, "id", "left_semi"))
    return owners.agg(F.countDistinct("id").alias("frontier_count"))


def _callees(edges: DataFrame, seeds: DataFrame, depth: int, bodies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows of all levels, and the ids that the next one would start from."""
    calls, over = _calls(edges), _overrides(edges, once=False)
    calls = with_callbacks(calls, bodies) if bodies is not None else calls
    frontier = cut(seeds.select("id").distinct())
    visited, out, last = [frontier], [], depth_of(depth)
    for d in range(1, last + 1):
        level = cut(semi(calls, "source_id", frontier).withColumn("depth", F.lit(d)))
        near = cut(frontier.unionByName(level.select(F.col("target_id").alias("id"))).where("id is not null").distinct())
        bridge = _bridge(semi(over, "iface", near).distinct())
        bridge = bridge.withColumn("via", F.lit(None).cast("string")) if bodies is not None else bridge
        bridge = cut(bridge.withColumn("depth", F.lit(d)))
        out += [level, bridge]
        frontier = near.unionByName(bridge.select(F.col("target_id").alias("id"))).distinct().join(_union(visited), "id", "left_anti")
        if d == last:
            break
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        visited.append(frontier)
    return _union(out), frontier


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 1, callbacks: bool = False) -> DataFrame:
    """Edges met going in to seeds (id). A node also brings in, once, each method it overrides that
    wasn't met before: the bridge and that method's callers have the same depth, and only the
    callers are followed. With callbacks, calls from synthetic bodies count as the outer method's."""
    calls, over = _calls(edges).where("target_id is not null"), _overrides(edges)
    if callbacks:
        calls = calls.withColumn("source_id", enclosing_method(F.col("source_id")))
    frontier = cut(seeds.select("id").distinct())
    visited, out = [frontier], []
    for d in range(1, depth_of(depth) + 1):
        level = calls.join(frontier.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        fresh = over.join(frontier.withColumnRenamed("id", "impl"), "impl", "left_semi").join(_union(visited).withColumnRenamed("id", "iface"), "iface", "left_anti")
        pairs = cut(fresh.groupBy("iface").agg(F.min("impl").alias("impl")))
        bridged = calls.join(pairs.select(F.col("iface").alias("target_id")), "target_id", "left_semi")
        both = cut(level.select(*ROW).unionByName(_bridge(pairs)).unionByName(bridged.select(*ROW)).withColumn("depth", F.lit(d)))
        out.append(both)
        visited.append(pairs.select(F.col("iface").alias("id")))
        frontier = cut(both.where("relation = 'CALLS'").select(F.col("source_id").alias("id")).distinct().join(_union(visited), "id", "left_anti"))
        if frontier.isEmpty():
            break
        visited.append(frontier)
    return _once(_union(out))


def external_callers(edges: DataFrame, found: DataFrame, depth: int = 1, callbacks: bool = False) -> DataFrame:
    """External edges as depth 1, and the callers of their sources beyond."""
    first = found.select(*ROW).withColumn("depth", F.lit(1))
    if callbacks:
        first = first.withColumn("source_id", enclosing_method(F.col("source_id")))
    if depth_of(depth) == 1:
        return _once(first)
    above = callers(edges, first.select(F.col("source_id").alias("id")), depth_of(depth) - 1, callbacks)
    return _once(first.unionByName(above.withColumn("depth", F.col("depth") + 1)))


def call_path(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int = 5, bodies: DataFrame | None = None) -> DataFrame:
    """(depth, source_id, target_id, relation): a shortest path, calls before overrides, then by the
    parent's and the node's id. A start is never an end of its own; no path gives no rows. With bodies
    (outer, body), calls made within callback bodies count as the outer method's."""
    calls = edges.where("relation = 'CALLS' and target_id is not null")
    calls = (calls if bodies is None else with_callbacks(calls, bodies)).select("source_id", "target_id", "relation", F.lit(0).alias("rank"))
    over = _overrides(edges).select(F.col("iface").alias("source_id"), F.col("impl").alias("target_id"), F.lit("OVERRIDES").alias("relation"), F.lit(1).alias("rank"))
    return _path(calls.unionByName(over), starts, ends, depth_of(depth, 5))


def _path(steps: DataFrame, starts: DataFrame, ends: DataFrame, depth: int, stop: DataFrame | None = None) -> DataFrame:
    """Shortest path over steps (source_id, target_id, relation, rank) as rows by depth. Nodes in
    stop are reached but not left. Parents are kept level by level and walked back with joins."""
    spark = steps.sparkSession
    frontier = cut(starts.select("id").distinct())
    visited, parents = [frontier], []
    empty = spark.createDataFrame([], "depth int, source_id string, target_id string, relation string")
    for d in range(1, depth + 1):
        live = frontier if stop is None else frontier.join(stop, "id", "left_anti")
        reach = steps.join(live.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(_union(visited).withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        level = cut(reach.groupBy("target_id").agg(F.min(F.struct("source_id", "rank", "relation")).alias("p")).select("target_id", F.col("p.source_id").alias("source_id"), F.col("p.relation").alias("relation")))
        parents.append(level)
        hit = level.join(ends.select(F.col("id").alias("target_id")), "target_id", "left_semi").agg(F.min("target_id").alias("id")).where("id is not null")
        if not hit.isEmpty():
            out, at = [], hit
            for k in range(d, 0, -1):
                row = cut(parents[k - 1].join(F.broadcast(at.withColumnRenamed("id", "target_id")), "target_id").withColumn("depth", F.lit(k)).select("depth", "source_id", "target_id", "relation"))
                out.append(row)
                at = row.select(F.col("source_id").alias("id"))
            return _union(out)
        frontier = level.select(F.col("target_id").alias("id"))
        if frontier.isEmpty():
            return empty
        visited.append(frontier)
    return empty


def flow_of(flow_edges: DataFrame, starts: DataFrame, depth: int = 8, limit: int | None = 200, reverse: bool = False) -> DataFrame:
    """Flow edges met from starts (id), each once, with depth; the first limit of them by depth and
    id. A level that fills the limit is the last. Without a limit (None) nothing is cut."""
    a, b = ("target_node", "source_node") if reverse else ("source_node", "target_node")
    frontier = cut(starts.select("id").distinct())
    visited, out, left = [frontier], [], limit
    seen = None
    for d in range(1, min(max(1, depth), 50) + 1):
        level = flow_edges.join(frontier.withColumnRenamed("id", a), a, "left_semi").select(*flow_edges.columns)
        if seen is not None:
            level = level.join(seen.select("id"), "id", "left_anti").select(*flow_edges.columns)
        level = level.withColumn("depth", F.lit(d))
        level = cut(level if left is None else level.orderBy("id").limit(left))
        out.append(level)
        if left is not None:
            left -= level.count()
        seen = _union(out)
        frontier = cut(level.select(F.col(b).alias("id")).distinct().join(_union(visited), "id", "left_anti"))
        if (left is not None and left <= 0) or frontier.isEmpty():
            break
        visited.append(frontier)
    return _union(out)


def flow_path(flow_edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int = 20, relations: tuple = DATA_FLOW) -> DataFrame:
    """A shortest path over flow edges of the given relations, ties by id."""
    steps = flow_edges.where(F.col("relation").isin(*relations)).select(F.col("source_node").alias("source_id"), F.col("target_node").alias("target_id"), "relation", F.lit(0).alias("rank"))
    return _path(steps, starts, ends, min(max(1, depth), 100))


def taint_path(flow_nodes: DataFrame, flow_edges: DataFrame, depth: int = 30, starts: DataFrame | None = None) -> DataFrame:
    """A shortest path from a taint source to a sink that leaves no sanitizer and enters sinks only
    as the argument their slot names."""
    source = flow_nodes.where("kind = 'TAINT_SOURCE'").select("id") if starts is None else starts
    sinks = flow_nodes.where("kind = 'TAINT_SINK'").select("id", "slot")
    clean = flow_nodes.where("kind = 'SANITIZER'").select("id")
    e = flow_edges.where(F.col("relation").isin(*DATA_FLOW)).join(sinks.select(F.col("id").alias("target_node"), F.lit(True).alias("sink"), "slot"), "target_node", "left")
    e = e.where("sink is null or (relation = 'ARGUMENT_FLOW' and context <=> slot)")
    steps = e.select(F.col("source_node").alias("source_id"), F.col("target_node").alias("target_id"), "relation", F.lit(0).alias("rank"))
    return _path(steps, source, sinks.select("id"), min(max(1, depth), 100), clean)


def guards_of(flow_nodes: DataFrame, flow_edges: DataFrame, method: str | None = None) -> DataFrame:
    """Guard edges with the labels of both ends."""
    own = flow_edges.where("relation in ('GUARD_TRUE', 'GUARD_FALSE', 'CONDITION_FLOW')")
    return _ends(flow_nodes, own if method is None else own.where(F.col("method_id") == method))


def exception_flow(flow_nodes: DataFrame, flow_edges: DataFrame, method: str | None = None) -> DataFrame:
    own = flow_edges.where("relation = 'EXCEPTION_FLOW'")
    return _ends(flow_nodes, own if method is None else own.where(F.col("method_id") == method))


def _ends(flow_nodes: DataFrame, own: DataFrame) -> DataFrame:
    s = flow_nodes.select(F.col("id").alias("source_node"), F.col("kind").alias("source_kind"), F.col("line").alias("source_line"))
    t = flow_nodes.select(F.col("id").alias("target_node"), F.col("kind").alias("target_kind"), F.col("line").alias("target_line"))
    return own.join(s, "source_node").join(t, "target_node").select("method_id", "relation", "source_node", "source_kind", "source_line", "target_node", "target_kind", "target_line")


def callers_frontier(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(frontier_count): callers, and methods overridden that weren't met, beyond the depth."""
    known = callers(edges, seeds, depth)
    met = known.select(F.col("source_id").alias("id")).unionByName(known.select(F.col("target_id").alias("id"))).unionByName(seeds.select("id")).distinct()
    last = known.where((F.col("relation") == "CALLS") & (F.col("depth") == depth_of(depth))).select(F.col("source_id").alias("id")).distinct()
    earlier = known.where(F.col("depth") < depth_of(depth)).select(F.col("source_id").alias("id")).unionByName(seeds.select("id")).distinct()
    last = cut(last.join(earlier, "id", "left_anti"))
    calls = _calls(edges).where("target_id is not null")
    fresh = _overrides(edges).join(last.withColumnRenamed("id", "impl"), "impl", "left_semi").select(F.col("iface").alias("id")).distinct().join(met, "id", "left_anti")
    into = calls.join(last.unionByName(fresh).distinct().withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return into.unionByName(fresh).agg(F.countDistinct("id").alias("frontier_count"))


def flow_frontier(flow_edges: DataFrame, reached: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(frontier_count): nodes first reached at depth (rows of flow_of) that have edges not met."""
    a, b = ("target_node", "source_node") if reverse else ("source_node", "target_node")
    last = reached.where(F.col("depth") == depth).select(F.col(b).alias("id")).distinct().join(reached.select(F.col(a).alias("id")).distinct(), "id", "left_anti")
    more = flow_edges.join(last.withColumnRenamed("id", a), a, "left_semi").join(reached.select("id"), "id", "left_anti")
    return more.agg(F.countDistinct(a).alias("frontier_count"))


def flow_endpoint(methods: DataFrame, coverage: DataFrame, slot: str | None = None, need_slot: bool = False) -> str:
    """The only method of an endpoint (method_id), whose flow must be there in full (method_id,
    detail_level). Errors carry codes."""
    found = [r.method_id for r in methods.select("method_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError("FLOW_ENDPOINT_AMBIGUOUS: more than one method")
    if not found:
        raise LookupError("FLOW_ENDPOINT_UNKNOWN: no such method")
    if need_slot and slot is None:
        raise ValueError("FLOW_SLOT_REQUIRED: name a slot of the endpoint")
    if coverage.where((F.col("method_id") == found[0]) & (F.col("detail_level") == "DETAIL")).isEmpty():
        raise ValueError("FLOW_COVERAGE_MISSING: the method's flow isn't built in detail")
    return found[0]


def flow_summary(summaries: DataFrame, method: str, limit: int = 200) -> DataFrame:
    return summaries.where(F.col("method_id") == method).orderBy("input_slot", "output_slot", "relation").limit(limit)


def files_to_materialize(path: DataFrame, nodes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(source_file) of the methods on a call path whose flow isn't there in detail."""
    ids = path.select(F.col("source_id").alias("id")).unionByName(path.select(F.col("target_id").alias("id"))).distinct()
    done = coverage.where("detail_level = 'DETAIL'").select(F.col("method_id").alias("id"))
    return nodes.join(ids.join(done, "id", "left_anti"), "id", "left_semi").select("source_file").distinct()
