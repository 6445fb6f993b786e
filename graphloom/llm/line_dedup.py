"""Line dedup by overlapping three-line windows.

Each window of WIDTH consecutive lines is hashed; of all windows with one hash, over all documents,
the first in (doc_id, row, line) order stays, and the later ones' lines are covered. Covered lines
of a document are merged and removed. Only hashes and positions are shuffled until the covered
lines meet their texts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import UID, with_uid

WIDTH = 3


def _lines(text: str) -> F.Column:
    return F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))


def covered_lines(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row key, lines): the 0-based numbers of the lines of each row that go."""
    rows = keyed.where("text is not null").select(UID, "doc_id", _lines("text").alias("lines")).where(F.size("lines") >= width)
    at = F.sequence(F.lit(0), F.size("lines") - width)
    grams = F.transform(at, lambda i: F.slice("lines", i + 1, width))
    # two hashes of 64 bits; windows of nothing but empty lines are no content
    marks = F.filter(
        F.transform(F.arrays_zip(at.alias("i"), grams.alias("g")), lambda z: F.struct(z["i"].alias("at"), F.xxhash64(z["g"]).alias("h1"), F.xxhash64(F.concat_ws("\n", F.reverse(z["g"])), F.lit(7)).alias("h2"), (F.concat_ws("", z["g"]) != "").alias("full"))),
        lambda m: m["full"],
    )
    windows = rows.select(UID, "doc_id", F.explode(marks).alias("m")).select(UID, "doc_id", "m.at", "m.h1", "m.h2")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(UID).alias("key"), F.col("at").alias("at"))
    # the least place of each hash by a partial aggregate, so that a hash of many copies is no hot spot
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, ["h1", "h2"]).where((F.col(UID) != F.col("first.key")) | (F.col("at") != F.col("first.at")))
    return later.groupBy(UID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + (width - 1)))))).alias("lines"))


def line_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, removed) of each row of docs: the text without its covered lines and how many
    these are.

    Lines are compared without the spaces around them, and kept as they were. Windows of empty
    lines only never count; texts of fewer than width lines are left alone. Null texts stay null,
    empty ones empty, with 0 removed. Windows that overlap within one text count like any others.
    Repeated rows lose all that an earlier one has; null doc_ids come last in the order. An empty
    table gives no rows. Other columns are not read.
    """
    keyed = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    cut = covered_lines(keyed, width)
    numbered = F.arrays_zip(F.split("text", "\n").alias("line"), F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1).alias("i"))
    kept = F.transform(F.filter(numbered, lambda z: ~F.array_contains(F.col("lines"), z["i"])), lambda z: z["line"])
    return keyed.join(cut, UID, "left").select("doc_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("removed"))


SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i AS p, w[i + 1:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM l WHERE len(w) >= 3)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM g WHERE array_to_string(g, '') <> ''),
c AS (SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS cut FROM r WHERE n > 1 GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(raw)), lambda i: NOT list_contains(cut, i)), lambda i: raw[i + 1]), chr(10)) END AS text,
  CAST(coalesce(len(cut), 0) AS BIGINT) AS removed
FROM l LEFT JOIN c USING (doc_id) UNION ALL SELECT doc_id, text, CAST(0 AS BIGINT) FROM documents WHERE text IS NULL"""
