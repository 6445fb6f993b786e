"""File sources: source trees, documents, bean XML, annotation batches, settings and rules."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.identity import glob_regex
from graphloom.schema import SEMANTIC

RULE_FILE_BYTES, RULES_EACH, RULE_CHARS = 1 << 20, 256, 512


def source_files(spark: SparkSession, root: str, suffix: str = "java", excludes: list[str] | None = None) -> DataFrame:
    """(source_file, content, hash, file_size, file_mtime_ns) of the files below root; excludes are
    globs on the path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    below = re.sub("^file:/*", "/", root).rstrip("/") + "/"
    own = raw.select(F.replace(path, F.lit(below), F.lit("")).alias("source_file"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("file_mtime_ns"))
    for glob in excludes or []:
        own = own.where(~F.col("source_file").rlike(glob_regex(glob)))
    return own


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, content, doc_type, module): READMEs, ADRs and what lies under docs; no changelogs
    and nothing of build folders. The title is the first heading, else the file's stem."""
    own = source_files(spark, root, "md")
    name = F.substring_index("source_file", "/", -1)
    kind = F.when(name.rlike(r"(?i)^ADR-"), "ADR").when(name.rlike(r"(?i)^README"), "README").when(F.col("source_file").rlike(r"(^|/)docs/"), "DOC")
    own = own.withColumn("doc_type", kind).where("doc_type is not null").where(~name.rlike("(?i)^changelog") & ~F.col("source_file").rlike("(^|/)(target|build|node_modules|out)/"))
    head = F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1)
    title = F.when(head == "", F.regexp_replace(name, r"\.md$", "")).otherwise(head)
    module = F.when(F.contains(F.col("source_file"), F.lit("/")), F.substring_index("source_file", "/", 1))
    return own.select(F.col("source_file").alias("path"), title.alias("title"), "content", "doc_type", module.alias("module"))


def xml_beans(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of bean files (source_file, content): beans, their classes, properties and
    references, by XPath on whole files."""
    import pandas as pd

    schema = "part string, id string, label string, kind string, source_id string, target_id string, external_target_fqn string, relation string, source_file string"

    def parse(batches):
        import xml.etree.ElementTree as ET

        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for pdf in batches:
            rows = []
            for file, content in pdf[["source_file", "content"]].itertuples(index=False):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue

                def node(key, label, kind):
                    rows.append(("node", key, label, kind, None, None, None, None, file))

                def edge(a, b, x, relation):
                    rows.append(("edge", None, None, None, a, b, x, relation, file))

                def walk(e, key):
                    for k, child in enumerate(e):
                        tag = local(child)
                        if tag not in ("property", "constructor-arg", "list", "map", "entry", "ref", "value", "null", "idref"):
                            continue
                        kind = "XML_" + tag.upper().replace("-", "_")
                        label = child.get("name") or child.get("key") or child.get("bean") or tag
                        own = f"{key}/{tag}[{k}]"
                        node(own, label, kind)
                        edge(key, own, None, "CONFIGURES" if tag in ("property", "constructor-arg") else "XML_CONTAINS")
                        to = child.get("ref") or child.get("bean") or child.get("value-ref")
                        if to:
                            edge(own, f"bean:{to}@{file}", None, "XML_REFERS_TO")
                        walk(child, own)

                for k, bean in enumerate(x for x in root.iter() if local(x) == "bean"):
                    name = bean.get("id") or bean.get("name") or f"{bean.get('class')}#{k}"
                    key = f"bean:{name}@{file}"
                    node(key, name, "BEAN")
                    if bean.get("class"):
                        edge(key, None, bean.get("class"), "DEFINED_BY")
                    walk(bean, key)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    facts = files.select("source_file", "content").mapInPandas(parse, schema)
    nodes = facts.where("part = 'node'").select("id", "label", "kind", "source_file")
    edges = facts.where("part = 'edge'").select("source_id", "target_id", "external_target_fqn", "relation", F.col("target_id").isNull().alias("is_external"), "source_file")
    return nodes, edges


def bean_wires(edges: DataFrame) -> DataFrame:
    """(source_id, target_id): beans wired by the references anywhere below them."""
    ref = edges.where("relation = 'XML_REFERS_TO'")
    return ref.select(F.substring_index("source_id", "/", 1).alias("a"), "target_id", "source_id").select(F.regexp_extract("source_id", r"^(bean:[^@]*@.*?\.xml)", 1).alias("source_id"), "target_id").distinct()


def annotation_batch(spark: SparkSession, path: str) -> DataFrame:
    """Semantic annotations of a JSON file, checked against the vocabularies."""
    rows = spark.read.schema(SEMANTIC).option("multiLine", "true").json(path)
    bad = rows.where(~F.coalesce(F.col("source").isin("DOC", "LLM") & F.col("confidence").isin("HIGH", "MEDIUM", "LOW"), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("source must be DOC or LLM, confidence HIGH, MEDIUM or LOW")
    return rows


def _bytes(path: str, spark: SparkSession | None, most: int) -> bytes | None:
    """A small file, by Spark's file systems where a session is given; None if it is larger than most."""
    if spark is None:
        with open(path, "rb") as f:
            raw = f.read(most + 1)
        return raw if len(raw) <= most else None
    found = spark.read.format("binaryFile").load(path)
    if found.isEmpty():
        raise FileNotFoundError(path)
    row = found.where(F.col("length") <= most).select("content").first()
    return None if row is None else bytes(row.content)


def settings(path: str, spark: SparkSession | None = None) -> dict:
    raw = _bytes(path, spark, RULE_FILE_BYTES)
    if raw is None:
        raise ValueError("the settings are larger than 1 MiB")
    return tomllib.loads(raw.decode())


def taint_rules(path: str, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """Globs of sources, sinks and sanitizers, within fixed limits."""
    raw = _bytes(path, spark, RULE_FILE_BYTES)
    if raw is None:
        raise ValueError("the rule file is larger than 1 MiB")
    rules = {k: list(json.loads(raw).get(k, [])) for k in ("sources", "sinks", "sanitizers")}
    if any(len(v) > RULES_EACH or any(not isinstance(r, str) or len(r) > RULE_CHARS for r in v) for v in rules.values()):
        raise ValueError("at most 256 rules of a kind, of 512 characters at most")
    return rules


def classify(calls: DataFrame, rules: dict[str, list[str]], column: str = "callee_method") -> DataFrame:
    """calls with their taint kind: source before sink before sanitizer."""
    kind = F.lit(None).cast("string")
    for name, value in (("sanitizers", "SANITIZER"), ("sinks", "TAINT_SINK"), ("sources", "TAINT_SOURCE")):
        for rule in rules.get(name, []):
            kind = F.when(F.col(column).rlike(glob_regex(rule)), value).otherwise(kind)
    return calls.withColumn("taint", kind)


def flow_scope(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """Nodes that one of package:GLOB, method:GLOB, source:GLOB selects; all without selectors."""
    columns = {"package": "package", "method": "qualified_name", "source": "source_file"}
    wanted = None
    for s in selectors:
        kind, _, glob = s.partition(":")
        if kind not in columns:
            raise ValueError(f"no selector {kind}")
        hit = F.coalesce(F.col(columns[kind]).rlike(glob_regex(glob)), F.lit(False))
        wanted = hit if wanted is None else wanted | hit
    return nodes if wanted is None else nodes.where(wanted)
