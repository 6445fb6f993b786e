"""Point lookups, edge scans, filters, tiered name resolution and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identity import glob_like, in_branch, in_loop, line_of
from graphloom.schema import METHOD_KINDS, SCOPES, TYPE_KINDS


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is in ids.id."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with label and qualified name of both ends; edges of unknown ends stay."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"), F.col("qualified_name").alias("target_qualified_name"))
    return edges.join(s, "source_id", "left").join(t, "target_id", "left")


def in_scope(nodes: DataFrame, module: str | None = None, scope: str = "MAIN") -> DataFrame:
    """Nodes of a module and scope; scope ALL is any."""
    if scope not in (*SCOPES, "ALL"):
        raise ValueError(f"no scope {scope}")
    out = nodes if scope == "ALL" else nodes.where(F.col("scope") == scope)
    return out if module is None else out.where(F.col("module") == module)


def starts_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column begins with prefix; reaches the scan as a range."""
    return df.where(F.col(column).startswith(prefix))


def external_calls(edges: DataFrame, method: str) -> DataFrame:
    """External call edges to a signature, or, without parentheses, to any overload of a method."""
    x = F.col("external_target_fqn")
    wanted = x == method if "(" in method else (F.lower(x).startswith(method.lower() + "(")) | (F.lower(x) == method.lower())
    return edges.where(F.col("is_external") & (F.col("relation") == "CALLS") & wanted)


def by_tier(nodes: DataFrame, tiers: list[Column]) -> DataFrame:
    """Rows of the first tier that has any. One pass: each row gets its lowest tier, and the lowest
    of all is found by an aggregate of one row."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers)])
    ranked = nodes.withColumn("tier", tier).where("tier is not null")
    return ranked.join(F.broadcast(ranked.agg(F.min("tier").alias("tier"))), "tier", "left_semi").drop("tier")


def resolve_type(nodes: DataFrame, ref: str, module: str | None = None, scope: str = "MAIN") -> DataFrame:
    """Types by storage key, then qualified name, then label; the part after # is dropped."""
    x = ref.split("#")[0]
    return by_tier(in_scope(nodes.where(F.col("kind").isin(*TYPE_KINDS)), module, scope), [F.col("id") == x, F.col("qualified_name") == x, F.col("label") == x])


def resolve_method(nodes: DataFrame, ref: str, module: str | None = None, scope: str = "MAIN") -> DataFrame:
    """Methods by key or signature, qualified name, Type#name, dotted name, then label."""
    own = in_scope(nodes.where(F.col("kind").isin(*METHOD_KINDS)), module, scope)
    q = F.col("qualified_name")
    if ref.endswith(")"):
        return own.where((F.col("id") == ref) | (F.col("symbol_id") == ref))
    if "#" in ref:
        return by_tier(own, [q == ref, F.lower(q).endswith("." + ref.lower())])
    if "." in ref:
        owner, _, name = ref.rpartition(".")
        return by_tier(own, [q == f"{owner}#{name}", F.lower(q).endswith(f".{owner}#{name}".lower())])
    return own.where(F.col("label") == ref)


def resolve_node(nodes: DataFrame, ref: str, module: str | None = None, scope: str = "MAIN") -> DataFrame:
    """All candidates of a name: methods first if it holds # or (, else types, else methods. The
    first by id is the answer where one is wanted."""
    first = [resolve_method(nodes, ref, module, scope)] if "#" in ref or "(" in ref else []
    tiers = [*first, resolve_type(nodes, ref, module, scope), resolve_method(nodes, ref, module, scope)]
    both = reduce(DataFrame.unionByName, [t.select(*nodes.columns).withColumn("__tier", F.lit(i)) for i, t in enumerate(tiers)])
    return both.join(F.broadcast(both.agg(F.min("__tier").alias("__tier"))), "__tier", "left_semi").select(*nodes.columns)


def resolve_field(nodes: DataFrame, ref: str, module: str | None = None, scope: str = "MAIN") -> DataFrame:
    """Fields by key or symbol, Type.field or Type#field, then label."""
    own = in_scope(nodes.where("kind = 'FIELD'"), module, scope)
    dotted = ref.replace("#", ".").rpartition(".")
    tiers = [(F.col("id") == ref) | (F.col("symbol_id") == ref)]
    if dotted[0]:
        q = F.replace(F.col("qualified_name"), F.lit("#"), F.lit("."))
        tiers += [(q == f"{dotted[0]}.{dotted[2]}") | q.endswith(f".{dotted[0]}.{dotted[2]}")]
    return by_tier(own, [*tiers, F.col("label") == ref])


def resolve_flow_methods(nodes: DataFrame, flow_nodes: DataFrame, ref: str) -> DataFrame:
    """(method_id) by id, symbol, qualified name or a part of it; else methods that only flow knows."""
    like = nodes.where(F.col("kind").isin(*METHOD_KINDS, "LAMBDA", "METHOD_REF")).where((F.col("id") == ref) | (F.col("symbol_id") == ref) | F.lower("qualified_name").contains(ref.lower()))
    known = like.select(F.col("id").alias("method_id"), F.lit(0).alias("tier"))
    other = flow_nodes.where(F.col("method_id") == ref).select("method_id", F.lit(1).alias("tier")).distinct()
    both = known.unionByName(other)
    return both.join(F.broadcast(both.agg(F.min("tier").alias("tier"))), "tier", "left_semi").select("method_id").distinct()


def keyword(edges: DataFrame, word: str, narrow: bool = False) -> DataFrame:
    """Edges that hold word, in any case, in one of their names; narrow leaves out the source's id,
    the relation and the call kind."""
    names = ["source_label", "target_label", "target_id", "target_qualified_name", "external_target_fqn"]
    names += [] if narrow else ["source_id", "relation", "call_kind"]
    found = [F.coalesce(F.lower(F.col(n)).contains(word.lower()), F.lit(False)) for n in names if n in edges.columns]
    return edges.where(reduce(lambda a, b: a | b, found))


def in_context(edges: DataFrame, loop: bool = False, branch: bool = False) -> DataFrame:
    """Edges whose control path has a loop and / or a branch, as asked for."""
    out = edges.where(in_loop(F.col("context"))) if loop else edges
    return out.where(in_branch(F.col("context"))) if branch else out


def made_by_injection(edges: DataFrame) -> DataFrame:
    return edges.where(F.get_json_object("metadata", "$.via").isin("injection", "injected-call"))


def slot(flow_nodes: DataFrame, name: str | None) -> DataFrame:
    """Flow nodes of a slot: return, throw or arg:N; all without one."""
    if name is None:
        return flow_nodes
    if name == "return":
        return flow_nodes.where("kind = 'RETURN'")
    if name == "throw":
        return flow_nodes.where("kind in ('THROW', 'EXCEPTION')")
    if name.startswith("arg:") and name[4:].isdigit():
        return flow_nodes.where((F.col("kind") == "PARAMETER") & (F.col("slot") == name[4:]))
    raise ValueError("FLOW_SLOT_INVALID: a slot is return, throw or arg:N")


def diagnostics_like(diagnostics: DataFrame, file: str | None = None, **equal: str) -> DataFrame:
    out = diagnostics if file is None else diagnostics.where(F.col("source_file").contains(file))
    for name, value in equal.items():
        out = out.where(F.lower(F.col(name)) == value.lower())
    return out


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by a total order; more rows are not gathered than offset + limit."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def page_info(total: int, limit: int = 50, offset: int = 0) -> dict:
    start = min(max(0, offset), total)
    end = min(total, start + max(0, limit))
    return {"total": total, "offset": start, "returned": end - start, "truncated": end < total, "next_offset": end if end < total else None}


def source_windows(lines: DataFrame, places: DataFrame, around: int = 2) -> DataFrame:
    """(source_file, source_location, snippet): numbered lines around each place. Places reach the
    lines by exact line numbers, so that the join has equal keys and no range."""
    wanted = places.select("source_file", "source_location").distinct().withColumn("line", line_of(F.col("source_location"))).where("line is not null")
    spread = wanted.withColumn("number", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    got = spread.join(lines, ["source_file", "number"]).groupBy("source_file", "source_location")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda s: F.concat(s["number"].cast("string"), F.lit(": "), s["text"]))
    return got.agg(F.array_join(parts, "\n").alias("snippet"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """(source_file, number, text) of (source_file, content)."""
    return files.select("source_file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("source_file", (F.col("at") + 1).alias("number"), "text")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def by_label_glob(nodes: DataFrame, pattern: str) -> DataFrame:
    return nodes.where(F.col("label").ilike(glob_like(pattern)))


def branch_keyword(slices: DataFrame, edges: DataFrame, word: str) -> DataFrame:
    """Branch slices that hold word in their owner or context, or in one of their edges."""
    k = word.lower()
    own = F.lower("source_id").contains(k) | F.lower("context").contains(k)
    inner = edges.where(F.lower(F.coalesce("target_id", "external_target_fqn")).contains(k) | F.coalesce(F.lower("source_file").contains(k), F.lit(False))).select("source_id", "context").distinct().withColumn("__hit", F.lit(True))
    return slices.join(inner, ["source_id", "context"], "left").where(own | F.coalesce("__hit", F.lit(False))).drop("__hit")


def get_meta(meta: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Key / value rows, all or those of keys."""
    return meta.select("key", "value") if keys is None else meta.where(F.col("key").isin(*keys)).select("key", "value")


def put_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key / value rows with those of new in place of the old ones."""
    return meta.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))
