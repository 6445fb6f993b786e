"""Change detection, impact, incremental replacement and versioned tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.evidence import worth_increment
from graphloom.operators.hierarchy import implementors
from graphloom.schema import METHOD_KINDS, TYPE_KINDS
from graphloom.storage import cut


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "source_file", mark: str = "hash") -> DataFrame:
    """(key, change): added, deleted, changed or same, by a full outer join."""
    a, b = old.select(key, F.col(mark).alias("__o"), F.lit(True).alias("__a")), new.select(key, F.col(mark).alias("__n"), F.lit(True).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(F.col("__o").eqNullSafe(F.col("__n")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def file_changes(cache: DataFrame, now: DataFrame, verify: bool = False) -> DataFrame:
    """(source_file, change) of cached and present files (size, mtime, hash): equal size and time
    count as same unless verify asks for the hash; equal content of another time is refresh."""
    a = cache.select("source_file", F.col("hash").alias("oh"), F.col("file_size").alias("os"), F.col("file_mtime_ns").alias("om"), F.lit(True).alias("a"))
    b = now.select("source_file", F.col("hash").alias("nh"), F.col("file_size").alias("ns"), F.col("file_mtime_ns").alias("nm"), F.lit(True).alias("b"))
    stat = (F.col("os") == F.col("ns")) & (F.col("om") == F.col("nm"))
    fast = F.lit(False) if verify else stat
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(fast, "same").when(F.col("oh") != F.col("nh"), "changed").when(stat, "same").otherwise("refresh")
    return a.join(b, "source_file", "full").select("source_file", change.alias("change"))


CONTRACT = ("kind", "qualified_name", "package", "module", "scope", "metadata")


def symbol_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): nodes removed, added or changed in what others rely on."""
    a = old.select("id", F.struct(*CONTRACT).alias("o"), F.lit(True).alias("a"))
    b = new.select("id", F.struct(*CONTRACT).alias("n"), F.lit(True).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "contract")
    return a.join(b, "id", "full").select("id", change.alias("change")).where("change is not null")


def overload_family(delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the changed nodes and all that share a qualified name with one."""
    names = nodes.join(delta.select("id"), "id", "left_semi").select("qualified_name").distinct()
    return delta.select("id").unionByName(nodes.join(names, "qualified_name", "left_semi").select("id")).distinct()


def impacted_files(edges: DataFrame, ids: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """(source_file) of edges that reach ids, their owners, or external names with a given prefix."""
    reach = ids.select("id").unionByName(ids.select(F.substring_index("id", "#", 1).alias("id"))).distinct()
    out = edges.where("not is_external").join(reach.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_file")
    if externals is not None:
        owner = F.substring_index("external_target_fqn", "#", 1).alias("prefix")
        out = out.unionByName(edges.where("is_external").select("source_file", owner).join(externals, "prefix", "left_semi").select("source_file"))
    return out.where("source_file is not null").distinct()


def impact_closure(dependencies: DataFrame, changed: DataFrame, total: int, most: int | None = None) -> DataFrame | None:
    """(source_file, round): files to redo, until no new ones come; None where a full run is cheaper."""
    # each round reads the dependencies, which are made once
    dependencies = cut(dependencies.select("source_file", "depends_on_file"))
    frontier = cut(changed.select("source_file").distinct())
    out = frontier.withColumn("round", F.lit(0))
    count = frontier.count()
    r = 0
    while True:
        r += 1
        if not worth_increment(count, total, cap=most):
            return None
        next_files = dependencies.join(frontier.withColumnRenamed("source_file", "depends_on_file"), "depends_on_file", "left_semi").select("source_file").distinct()
        frontier = cut(next_files.join(out.select("source_file"), "source_file", "left_anti"))
        n = frontier.count()
        if n == 0:
            break
        count += n
        out = out.unionByName(frontier.withColumn("round", F.lit(r)))
    return out


def delta_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(target, how): what others may refer to of the nodes that a change removes, adds or changes.

    exact: removed and changed nodes, and the old methods of the same module, scope and qualified
    name as an added or removed one, for a call may now choose otherwise; owner: changed types;
    implementor: interfaces that a method comes to or leaves; external_prefix and external: names
    that added or changed nodes now answer to."""
    delta = symbol_delta(old, new)
    kind = ["id", "kind", "module", "scope", "qualified_name"]
    own = delta.join(new.select(*kind).unionByName(old.join(new, "id", "left_anti").select(*kind)), "id")
    method, declared = F.col("kind").isin(*METHOD_KINDS), F.col("kind").isin(*TYPE_KINDS)
    come_or_go = own.where(method & F.col("change").isin("added", "removed"))
    family = ["module", "scope", "qualified_name"]
    siblings = old.where(method).join(come_or_go.select(*family).distinct(), family, "left_semi").select("id")
    owners = come_or_go.select(F.substring_index("id", "#", 1).alias("id")).distinct()
    after = new.select("id", "kind").unionByName(old.join(new, "id", "left_anti").select("id", "kind"))
    faces = after.where("kind = 'INTERFACE'").join(owners, "id", "left_semi").select("id")
    # a type counts as changed if it was one before or is one now
    types = own.where("change = 'contract'").where(declared).select("id").unionByName(old.where(declared).join(own.where("change = 'contract'").select("id"), "id", "left_semi").select("id"))
    now = own.where("change in ('added', 'contract')")
    parts = [
        own.where("change in ('removed', 'contract')").select("id").unionByName(siblings).select(F.col("id").alias("target"), F.lit("exact").alias("how")),
        types.select(F.col("id").alias("target"), F.lit("owner").alias("how")),
        faces.select(F.col("id").alias("target"), F.lit("implementor").alias("how")),
        now.where(method).select(F.concat("qualified_name", F.lit("(")).alias("target"), F.lit("external_prefix").alias("how")),
        now.where(~method).select(F.col("qualified_name").alias("target"), F.lit("external").alias("how")),
        now.where(declared).select(F.concat("qualified_name", F.lit("#")).alias("target"), F.lit("external_prefix").alias("how")),
    ]
    return reduce(DataFrame.unionByName, parts).where("target is not null").distinct()


def files_of_targets(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_file) that delta_targets() may change: files of edges to exact targets, to owners or
    their members, of all that implement or inherit from an interface, directly or not, and of
    external edges to a name or to what begins with a prefix. A prefix ends in ( or #, so that it is
    looked up by equality with the part of the name up to there."""
    of = lambda how: targets.where(F.col("how") == how).select("target")
    inner, outer = edges.where("not is_external"), edges.where("is_external")
    exact = inner.join(of("exact").withColumnRenamed("target", "target_id"), "target_id", "left_semi")
    owner = inner.withColumn("__o", F.substring_index("target_id", "#", 1)).join(of("owner").withColumnRenamed("target", "__o"), "__o", "left_semi")
    name = F.col("external_target_fqn")
    upto = F.explode(F.array(F.concat(F.substring_index(name, "(", 1), F.lit("(")), F.concat(F.substring_index(name, "#", 1), F.lit("#"))))
    prefix = outer.where(name.contains("(") | name.contains("#")).withColumn("__p", upto).where(name.startswith(F.col("__p"))).join(of("external_prefix").withColumnRenamed("target", "__p"), "__p", "left_semi")
    same = outer.join(of("external").withColumnRenamed("target", "external_target_fqn"), "external_target_fqn", "left_semi")
    below = implementors(edges, of("implementor").withColumnRenamed("target", "id"), recursive=True)
    files = nodes.join(below.select("id"), "id", "left_semi").select("source_file")
    return reduce(DataFrame.unionByName, [x.select("source_file") for x in (exact, owner, prefix, same)], files).where("source_file is not null").distinct()


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """old without the rows of files, and new."""
    return old.join(files.select("source_file").distinct(), "source_file", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations replaced by (node_id, category, source); a null category equals none, so such rows
    are never replaced."""
    return old.join(new.select("node_id", "category", "source").distinct(), ["node_id", "category", "source"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


class Versions:
    """Tables written side by side under versions; a pointer file names the one that readers get.
    A version that isn't published is never seen, so a failed write leaves the last good one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, tables: dict[str, DataFrame]) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        self._publish(version)
        return version

    def _publish(self, version: str) -> None:
        n = len(self._pointers())
        draft, final = self._path(f"{self.path}/_draft-{version}"), self._path(f"{self.path}/_current/{n:010d}")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version}).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError("another writer published at the same time")

    def _pointers(self) -> list:
        folder = self._path(f"{self.path}/_current")
        return sorted((s.getPath().toString() for s in self._fs.listStatus(folder)), key=str) if self._fs.exists(folder) else []

    def current(self) -> str | None:
        names = self._pointers()
        if not names:
            return None
        stream = self._fs.open(self._path(names[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()}/{table}")
