"""What is known about some types, put together, and the state of a whole graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dependency import context, members, overview
from graphloom.operators.evidence import health
from graphloom.operators.sieve import semi
from graphloom.operators.traverse import called


def enriched(types: DataFrame, nodes: DataFrame, edges: DataFrame, annotations: DataFrame, semantic: DataFrame, related: DataFrame, depth: int = 1) -> DataFrame:
    """(section, id, detail): the context of the types, the callees of them and their members, what
    semantic (node_id, business_description) says of these, and related documents (id, snippet)."""
    own = members(types, edges)
    calls = called(edges, own, depth).withColumn("detail", F.concat_ws(" ", "relation", "target"))
    said = semi(semantic, "node_id", own)
    parts = [
        context(types, nodes, edges, annotations, own),
        calls.select(F.lit("callee").alias("section"), F.col("source_id").alias("id"), "detail"),
        said.select(F.lit("semantic").alias("section"), F.col("node_id").alias("id"), F.col("business_description").alias("detail")),
        related.select(F.lit("document").alias("section"), F.col("id").cast("string").alias("id"), F.col("snippet").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)


def baseline(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame, meta: DataFrame, project: str, policy: str = "error") -> DataFrame:
    """(packages, types, methods, dependencies, blocking, status) of a whole graph: IDENTITY_MISMATCH
    where meta (key, value) says that it was built from another project, BLOCKED where the policy
    doesn't let all diagnostics pass, else READY."""
    codes = health(diagnostics, policy).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocking")))).alias("blocking"))
    same = meta.where(F.col("key") == "project").agg(F.coalesce(F.max("value") == project, F.lit(False)).alias("same"))
    status = F.when(~F.col("same"), "IDENTITY_MISMATCH").when(F.size("blocking") > 0, "BLOCKED").otherwise("READY")
    return overview(nodes, edges).crossJoin(F.broadcast(codes)).crossJoin(F.broadcast(same)).withColumn("status", status).drop("same")
