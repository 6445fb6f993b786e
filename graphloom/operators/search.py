"""Full-text, name, annotation and external-type search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identity import glob_like
from graphloom.storage import cut

TOKEN = r"[\p{L}\p{N}]+"


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, term, tf, size): the inverted index, one row a document and term. The size is summed from
    the counts, for a text that was cut into terms twice would be cut anew for each term."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    terms = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counts.withColumn("size", F.sum("tf").over(Window.partitionBy(key)))


def terms(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, term, tf): the inverted index to be kept, one row a document and term."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def asked_counts(docs: DataFrame, key: str, columns: list[str], query: str) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) of the terms asked for alone, each for all that it is the beginning of, and
    (key, size): what ranked needs of an index that isn't kept. A document's terms are counted where
    it is read, and its counts are written."""
    asked = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns]))
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))).alias("term"))
    counts = [F.count_if(F.coalesce(_asked(asked) == t, F.lit(False))).alias(f"__{i}") for i, t in enumerate(asked)]
    kept = cut(found.groupBy(key).agg(F.count("*").alias("size"), *counts))
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"__{i}").alias("tf")) for i, t in enumerate(asked)])
    return kept.select(key, F.inline(pairs)).where("tf > 0"), kept.select(key, "size")


def _asked(terms: list[str]):
    """The first of the terms that a term begins with."""
    return F.coalesce(*[F.when(F.col("term").startswith(t), F.lit(t)) for t in terms])


def sizes(index: DataFrame, key: str) -> DataFrame:
    """(key, size): how many terms each document has."""
    return index.groupBy(key).agg(F.sum("tf").alias("size"))


def match(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that hold all terms of query. A plain term matches as a beginning; within quotes or with
    signs, the terms match whole."""
    raw = bool(re.search(r'[\s"():*-]', query))
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        return index.select(key).limit(0)
    hit = [F.max((F.col("term") == t if raw else F.col("term").startswith(t)).cast("int")) for t in terms]
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | (F.col("term") == t if raw else F.col("term").startswith(t))
    every = F.lit(True)
    for h in hit:
        every = every & (h == 1)
    return index.where(wanted).groupBy(key).agg(every.alias("all")).where("all").select(key)


def ranked(index: DataFrame, key: str, query: str, k1: float = 1.2, b: float = 0.75, size: DataFrame | None = None) -> DataFrame:
    """(key, score) by BM25 with prefix terms counted as one term. The index's number of documents
    and mean size come from one aggregate row. With a table size of (key, size) the index needs none,
    and only its rows of the terms asked for are read."""
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    stats = (index.select(key, "size").distinct() if size is None else size).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    wanted = _asked(terms)
    own = index.where(reduce(lambda x, y: x | y, [F.col("term").startswith(t) for t in terms], F.lit(False)))
    if size is not None:
        own = own.join(size, key)
    hits = own.withColumn("asked", wanted).groupBy(key, "size", "asked").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("asked").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return hits.join(df, "asked").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(part).alias("score"))


def search(nodes: DataFrame, query: str, kind: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Nodes whose qualified name, label or documentation match query; with a kept index (id, term)
    their texts aren't read."""
    own = nodes if kind is None else nodes.where(F.col("kind") == kind)
    if index is not None:
        return own.join(match(index, "id", query), "id", "left_semi")
    return own.join(match(postings(own, "id", ["qualified_name", "label", "javadoc"]), "id", query), "id", "left_semi")


def by_annotation(nodes: DataFrame, annotations: DataFrame, name: str) -> DataFrame:
    """Nodes that bear an annotation whose name contains name; a leading @ is dropped."""
    like = annotations.where(F.col("annotation_fqn").ilike(f"%{name.lstrip('@')}%")).select(F.col("node_id").alias("id"))
    return nodes.join(like, "id", "left_semi")


def external_types(edges: DataFrame, pattern: str | None = None) -> DataFrame:
    """(external_type, edges, relations, resolutions, confidences): types outside the graph and how
    often each is met, by two levels of grouping."""
    own = edges.where("is_external").select(F.substring_index("external_target_fqn", "#", 1).alias("external_type"), "relation", F.coalesce("resolution", F.lit("classpath")).alias("resolution"), "confidence")
    if pattern is not None:
        like = glob_like(pattern)
        own = own.where(F.col("external_type").ilike(f"%.{like}") | (F.col("external_type") == like))
    one = own.groupBy("external_type", "relation", "resolution", "confidence").agg(F.count("*").alias("n"))

    def tally(column: str):
        names = F.array_sort(F.collect_set(column))
        pairs = F.collect_list(F.struct(F.col(column).alias("k"), "n"))
        return F.map_from_arrays(names, F.transform(names, lambda x: F.aggregate(F.filter(pairs, lambda p: p["k"] == x), F.lit(0).cast("long"), lambda a, p: a + p["n"])))

    return one.groupBy("external_type").agg(F.sum("n").alias("edges"), tally("relation").alias("relations"), tally("resolution").alias("resolutions"), tally("confidence").alias("confidences"))


def real_then_external(real: DataFrame, external: DataFrame) -> DataFrame:
    """(ordinal_group, name, kind, edges): found nodes before virtual types, for one order over both."""
    a = real.select(F.lit(0).alias("part"), F.col("qualified_name").alias("name"), "kind", F.lit(None).cast("long").alias("edges"))
    b = external.select(F.lit(1).alias("part"), F.col("external_type").alias("name"), F.lit("EXTERNAL_CLASS").alias("kind"), "edges")
    return a.unionByName(b)


def search_page(real: DataFrame, external: DataFrame, word: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """(ordinal, id, label, kind, edges, total, label_matches): one page of the found nodes by name,
    then of the virtual types by edges, most first, and name; with the number of all results and, of
    this page's, those whose label holds word. More rows than offset + limit are not gathered."""
    a = real.select(F.lit(0).alias("part"), "id", "label", "kind", F.col("qualified_name").alias("name"), F.lit(0).cast("long").alias("edges"))
    b = external.select(F.lit(1).alias("part"), F.col("external_type").alias("id"), F.substring_index("external_type", ".", -1).alias("label"), F.lit("EXTERNAL_CLASS").alias("kind"), F.col("external_type").alias("name"), "edges")
    both = a.unionByName(b)
    start, size = max(0, offset), limit if limit > 0 else 20
    top = both.orderBy("part", F.desc("edges"), "name", "id").limit(start + size)
    order = Window.orderBy("part", F.desc("edges"), "name", "id")
    # a page of a bounded number of rows is numbered in one task
    page = top.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") > start)
    hit = F.coalesce(F.contains(F.lower("label"), F.lit(word.replace("*", "").lower())), F.lit(False))
    out = page.withColumn("label_matches", F.count_if(hit).over(Window.partitionBy()))
    return out.crossJoin(F.broadcast(both.agg(F.count("*").alias("total")))).select("ordinal", "id", "label", "kind", "edges", "total", "label_matches")


def by_edges(external: DataFrame) -> DataFrame:
    """External types, most edges first, then by name."""
    return external.orderBy(F.desc("edges"), "external_type")


def related_documents(docs: DataFrame, key: str, columns: list[str], query: str, top: int = 3, snippet: str = "content") -> DataFrame:
    """The best documents for a query with the first 200 characters of each."""
    index, size = asked_counts(docs, key, columns, query)
    best = ranked(index, key, query, size=size).orderBy(F.desc("score"), key).limit(top)
    return docs.join(F.broadcast(best), key).select(key, "score", F.substring(F.col(snippet), 1, 200).alias("snippet"))
