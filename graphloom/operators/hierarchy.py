"""Closures over inheritance, and the bean tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import cut

MAX_DEPTH = 20


def hierarchy(edges: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(source_id, target_id, external_target_fqn, relation, depth): the chain of INHERITS from the
    seeds, every path given (a diamond repeats its top), the seeds' external parents, and the
    interfaces that the seeds implement directly."""
    up = edges.where("relation = 'INHERITS'").select("source_id", "target_id", "external_target_fqn", "relation")
    own = seeds.select(F.col("id").alias("source_id"))
    # paths are counted from level to level, and spread to rows only in the result
    level, out = own.groupBy("source_id").agg(F.count("*").alias("paths")), []
    for d in range(1, depth + 1):
        rows = cut(up.where("target_id is not null").join(level, "source_id"))
        if rows.isEmpty():
            break
        out.append(rows.withColumn("depth", F.lit(d)).withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("paths")))).drop("paths", "each"))
        level = rows.groupBy(F.col("target_id").alias("source_id")).agg(F.sum("paths").alias("paths"))
    reached = len(out)
    beyond = up.where("target_id is null").join(own, "source_id", "left_semi").withColumn("depth", F.lit(max(1, reached)))
    direct = edges.where("relation = 'IMPLEMENTS'").join(own, "source_id", "left_semi").select("source_id", "target_id", "external_target_fqn", "relation").withColumn("depth", F.lit(1))
    return reduce(DataFrame.unionByName, [*out, beyond, direct])


def implementors(edges: DataFrame, seeds: DataFrame, recursive: bool = False) -> DataFrame:
    """(id, depth) of what implements or inherits from the seeds: one hop, or each once in the
    closure with its least depth."""
    down = edges.where("relation in ('IMPLEMENTS', 'INHERITS') and not is_external").select(F.col("target_id").alias("up"), F.col("source_id").alias("id"))
    frontier = cut(seeds.select("id").distinct())
    visited, out, d = [frontier], [], 0
    while recursive or d == 0:
        d += 1
        level = down.join(frontier.withColumnRenamed("id", "up"), "up", "left_semi").select("id").distinct()
        if recursive:
            level = level.join(reduce(DataFrame.unionByName, visited), "id", "left_anti")
        frontier = cut(level)
        if frontier.isEmpty() and out:
            break
        out.append(frontier.withColumn("depth", F.lit(d)))
        visited.append(frontier)
    return reduce(DataFrame.unionByName, out)


def bean_tree(nodes: DataFrame, edges: DataFrame, name: str, prop: str | None = None, most: int = 20) -> DataFrame:
    """(bean, path, id, refers_to): up to most beans whose label holds name, the exact one first,
    and what they configure, by paths of any length; what is on its own path already ends there. A
    property keeps that one of the first level only."""
    beans = nodes.where("kind = 'BEAN'").where(F.col("label").ilike(f"%{name}%")).orderBy(F.when(F.col("label") == name, 0).otherwise(1), "label", "id").limit(most).select("id")
    below = edges.where("relation in ('CONFIGURES', 'XML_CONTAINS') and not is_external").select(F.col("source_id").alias("above"), F.col("target_id").alias("id"))
    # a level meets one table, in which what is below has its label already
    below = cut(below.join(nodes.select("id", "label"), "id"))
    level = cut(beans.select(F.col("id").alias("bean"), "id", F.lit("").alias("path"), F.array("id").alias("trail")))
    out = [level]
    while True:
        level = level.withColumnRenamed("id", "above").join(below, "above").where(~F.array_contains("trail", F.col("id")))
        level = level.select("bean", "id", F.concat("path", F.lit("/"), "label").alias("path"), F.array_append("trail", F.col("id")).alias("trail"))
        if len(out) == 1 and prop is not None:
            level = level.where(F.col("path") == f"/{prop}")
        level = cut(level)
        if level.isEmpty():
            break
        out.append(level)
    refers = edges.where("relation = 'XML_REFERS_TO'").select(F.col("source_id").alias("id"), F.coalesce("target_id", "external_target_fqn").alias("refers_to"))
    return reduce(DataFrame.unionByName, out).join(refers, "id", "left").select("bean", "path", "id", "refers_to")
