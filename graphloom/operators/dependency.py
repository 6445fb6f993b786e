"""Direct dependencies, contexts, packages and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identity import innermost_branch, line_of
from graphloom.operators.sieve import semi
from graphloom.schema import DEPENDENCY, FRAMEWORK, METHOD_KINDS, PACKAGE_DEPENDENCY, TYPE_KINDS
from graphloom.storage import cut


def members(types: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the types and what they contain, one level down; written, for several joins read it."""
    own = cut(types.select("id").distinct())
    below = semi(edges.where("relation = 'CONTAINS'").select("source_id", "target_id"), "source_id", own).select(F.col("target_id").alias("id"))
    return cut(own.unionByName(below).distinct())


def deps_of(types: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependency edges that leave the types or their members."""
    return semi(edges.where(F.col("relation").isin(*DEPENDENCY)), "source_id", members(types, edges))


def used_by(types: DataFrame, edges: DataFrame, external: str | None = None) -> DataFrame:
    """Dependency edges that reach the types or their members, and, for a dotted name, external ones
    to the type or its members."""
    own = edges.where(F.col("relation").isin(*DEPENDENCY))
    out = semi(own.where(~F.col("is_external")), "target_id", members(types, edges))
    if external and "." in external:
        x = F.col("external_target_fqn")
        out = out.unionByName(own.where(F.col("is_external") & ((x == external) | x.startswith(external + "#"))))
    return out


def field_access(fields: DataFrame, edges: DataFrame, mode: str = "all") -> DataFrame:
    """Edges that read and / or write the fields, reads before writes in the column part."""
    wanted = {"read": ["READS"], "write": ["WRITES"], "all": ["READS", "WRITES"]}[mode]
    own = edges.where(F.col("relation").isin(*wanted)).join(fields.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return own.withColumn("part", (F.col("relation") == "WRITES").cast("int"))


def context(types: DataFrame, nodes: DataFrame, edges: DataFrame, annotations: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(section, id, detail): members, annotations and framework edges of the types; own are the
    members, where they are known."""
    own = members(types, edges) if own is None else own
    known = own.select(F.col("id").alias("source_id"))
    frame = edges.where(F.col("relation").isin(*FRAMEWORK)).select("source_id", "target_id", "external_target_fqn", "relation")
    # an edge with both ends among the members comes by its source
    touching = semi(frame, "source_id", own).unionByName(semi(frame, "target_id", own).join(known, "source_id", "left_anti"))
    parts = [
        types.select(F.lit("node").alias("section"), "id", F.col("kind").alias("detail")),
        semi(nodes.select("id", "kind"), "id", own).join(types.select("id"), "id", "left_anti").select(F.lit("member").alias("section"), "id", F.col("kind").alias("detail")),
        semi(annotations.select("node_id", "annotation_fqn"), "node_id", own).select(F.lit("annotation").alias("section"), F.col("node_id").alias("id"), F.col("annotation_fqn").alias("detail")),
        touching.select(F.lit("framework").alias("section"), F.col("source_id").alias("id"), F.concat_ws(" ", "relation", F.coalesce("target_id", "external_target_fqn")).alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "is_external").agg(F.count("*").alias("n"))


def file_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, nodes, edges): how many each file has; a file of one kind only has 0 of the other."""
    a = nodes.where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("nodes"))
    b = edges.where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("edges"))
    return a.join(b, "source_file", "full").na.fill(0, ["nodes", "edges"])


def package_tallies(nodes: DataFrame) -> DataFrame:
    types, methods = F.col("kind").isin(*TYPE_KINDS), F.col("kind").isin(*METHOD_KINDS)
    return nodes.where("package is not null").groupBy("package").agg(F.count_if(types).alias("types"), F.count_if(methods).alias("methods"))


def package_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_package, target_package, relation, n): edges between different packages. Edges are
    counted by the source's package before they meet their targets, so that few of them are left."""
    p = nodes.where("package is not null").select("id", "package")
    pairs = edges.where(F.col("relation").isin(*PACKAGE_DEPENDENCY) & ~F.col("is_external")).select("source_id", "target_id", "relation")
    s = p.select(F.col("id").alias("source_id"), F.col("package").alias("source_package"))
    t = p.select(F.col("id").alias("target_id"), F.col("package").alias("target_package"))
    some = pairs.join(s, "source_id").groupBy("source_package", "target_id", "relation").agg(F.count("*").alias("c"))
    both = some.join(t, "target_id").where("source_package <> target_package")
    return both.groupBy("source_package", "target_package", "relation").agg(F.sum("c").alias("n"))


def package_rollup(tallies: DataFrame, segments: int) -> DataFrame:
    """Package tallies by the first segments of the names."""
    return tallies.groupBy(F.substring_index("package", ".", segments).alias("package")).agg(F.sum("types").alias("types"), F.sum("methods").alias("methods"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(packages, types, methods, dependencies) of the whole graph."""
    a = nodes.agg(F.countDistinct("package").alias("packages"), F.count_if(F.col("kind").isin(*TYPE_KINDS)).alias("types"), F.count_if(F.col("kind").isin(*METHOD_KINDS)).alias("methods"))
    b = package_dependencies(nodes, edges).select("source_package", "target_package").distinct().agg(F.count("*").alias("dependencies"))
    return a.crossJoin(F.broadcast(b))


def chain_blocks(chain: DataFrame, nodes: DataFrame, edges: DataFrame, annotations: DataFrame, by: str = "class") -> DataFrame:
    """Call-chain rows (source_id, target_id, depth, context) cut into blocks of one class or package:
    methods, internal, outbound and inbound edges, fields read and written, annotations, depths."""
    owner = F.substring_index(F.col("id"), "#", 1)
    block = nodes.select("id", (owner if by == "class" else F.coalesce("package", F.lit(""))).alias("block"))
    s = block.select(F.col("id").alias("source_id"), F.col("block").alias("sb"))
    t = block.select(F.col("id").alias("target_id"), F.col("block").alias("tb"))
    tied = chain.where("target_id is not null").join(s, "source_id").join(t, "target_id")
    methods = tied.select(F.col("source_id").alias("id"), F.col("sb").alias("block"), "depth").unionByName(tied.select(F.col("target_id").alias("id"), F.col("tb").alias("block"), "depth"))
    a = methods.groupBy("block").agg(F.countDistinct("id").alias("methods"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"))
    ends = tied.select(F.col("sb").alias("block"), (F.col("sb") == F.col("tb")).alias("inner"), F.lit(True).alias("out")).unionByName(tied.where("sb <> tb").select(F.col("tb").alias("block"), F.lit(False).alias("inner"), F.lit(False).alias("out")))
    b = ends.groupBy("block").agg(F.count_if("inner").alias("internal"), F.count_if(~F.col("inner") & F.col("out")).alias("outbound"), F.count_if(~F.col("inner") & ~F.col("out")).alias("inbound"))
    ids = methods.select("id", "block").distinct()
    access = edges.where("relation in ('READS', 'WRITES')").join(ids.withColumnRenamed("id", "source_id"), "source_id").groupBy("block").agg(F.countDistinct(F.when(F.col("relation") == "READS", F.col("target_id"))).alias("reads"), F.countDistinct(F.when(F.col("relation") == "WRITES", F.col("target_id"))).alias("writes"))
    tags = annotations.join(ids.withColumnRenamed("id", "node_id"), "node_id").groupBy("block").agg(F.countDistinct("annotation_fqn").alias("annotations"))
    out = a.join(b, "block", "left").join(access, "block", "left").join(tags, "block", "left")
    return out.na.fill(0, ["internal", "outbound", "inbound", "reads", "writes", "annotations"])


def chain_block_lists(chain: DataFrame, nodes: DataFrame, edges: DataFrame, annotations: DataFrame, by: str = "class") -> DataFrame:
    """Blocks of chain_blocks() with what they hold, each list sorted and without repeats: methods,
    owning types, fields read and written, annotations, control contexts, and the documentation of
    the block's first method, by depth and id."""
    owner = F.substring_index(F.col("id"), "#", 1)
    block = nodes.select("id", (owner if by == "class" else F.coalesce("package", F.lit(""))).alias("block"))
    tied = chain.where("target_id is not null")
    # a chain whose other end isn't known belongs to no block, as in chain_blocks()
    both = tied.join(block.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(block.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    ends = both.select(F.col("source_id").alias("id"), "depth").unionByName(both.select(F.col("target_id").alias("id"), "depth"))
    methods = ends.groupBy("id").agg(F.min("depth").alias("depth")).join(block, "id").join(nodes.select("id", "javadoc"), "id")
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    a = methods.groupBy("block").agg(sorted_set("id").alias("methods"), sorted_set(owner).alias("types"), F.min_by("javadoc", F.struct("depth", "id")).alias("javadoc"))
    ids = methods.select("id", "block")
    access = edges.where("relation in ('READS', 'WRITES')").join(ids.withColumnRenamed("id", "source_id"), "source_id")
    b = access.groupBy("block").agg(sorted_set(F.when(F.col("relation") == "READS", F.col("target_id"))).alias("reads"), sorted_set(F.when(F.col("relation") == "WRITES", F.col("target_id"))).alias("writes"))
    c = annotations.join(ids.withColumnRenamed("id", "node_id"), "node_id").groupBy("block").agg(sorted_set("annotation_fqn").alias("annotations"))
    d = both.join(ids.withColumnRenamed("id", "source_id"), "source_id").groupBy("block").agg(sorted_set("context").alias("contexts"))
    out = a.join(b, "block", "left").join(c, "block", "left").join(d, "block", "left")
    none = F.array().cast("array<string>")
    lists = ("methods", "types", "reads", "writes", "annotations", "contexts")
    return out.select("block", *[F.coalesce(x, none).alias(x) for x in lists], "javadoc")


def branch_slices(edges: DataFrame) -> DataFrame:
    """(source_id, context, branch, line, n): calls and field accesses of each method by control
    path, with the kind and line of the innermost branch."""
    own = edges.where("relation in ('CALLS', 'READS', 'WRITES') and context is not null").withColumn("segment", innermost_branch(F.col("context"))).where("segment is not null")
    return own.groupBy("source_id", "context", F.substring_index("segment", "@", 1).alias("branch"), line_of(F.col("segment")).alias("line")).agg(F.count("*").alias("n"))
