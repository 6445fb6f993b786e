"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are the runs of WINDOW words of each benchmark item, or the whole item where it has
fewer. They are searched in the normalised documents with block shift tables: the block of
characters under the end of the search window says how far the window may jump; a jump of zero
leads to the bucket of test strings that end in that block, whose first characters and then whole
strings are compared directly. The shortest test string bounds all jumps of a table, so strings are
kept in one table for each class of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import numbered
from graphloom.storage import cut

WINDOW = 13
LEAST_WORDS = 5
#: characters of benchmark text that one pass over the documents searches for; more take more passes.
#: A worker's tables of so many take some 160 MB
PASS_CHARS = 1_000_000
_HEAD = 4
RESULT = "doc_id long, item_id long, matched long, windows long"


def normalised(text: str) -> F.Column:
    """Lower case, sharp s as ss, runs of anything but letters and digits as one space."""
    plain = F.replace(F.lower(F.col(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


class WuManber:
    """Search for many strings at once; find() yields the index of each occurrence's string."""

    def __init__(self, patterns: list[str]):
        self.tables = []
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                classes.setdefault(min(5, len(p).bit_length()), []).append(i)
        for members in classes.values():
            m = min(len(patterns[i]) for i in members)
            b = max(1, min(m, math.ceil(math.log(2 * m * len(members) + 1, 6))))
            shift: dict[str, int] = {}
            buckets: dict[str, list[tuple[str, str, int]]] = {}
            for i in members:
                p = patterns[i]
                for end in range(b, m + 1):
                    block = p[end - b : end]
                    if m - end < shift.get(block, m):
                        shift[block] = m - end
                buckets.setdefault(p[m - b : m], []).append((p[:_HEAD], p, i))
            self.tables.append((m, b, shift, buckets))

    def find(self, text: str) -> Iterator[int]:
        n = len(text)
        for m, b, shift, buckets in self.tables:
            jump, get, end = m - b + 1, shift.get, m
            while end <= n:
                block = text[end - b : end]
                step = get(block, jump)
                if step:
                    end += step
                    continue
                start = end - m
                head = text[start : start + _HEAD]
                for first, pattern, i in buckets[block]:
                    if head.startswith(first) and text.startswith(pattern, start):
                        yield i
                end += 1


class Matcher:
    """Items by their test strings: matches(text) gives {item: set of matched windows}."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW, least_words: int = LEAST_WORDS):
        owners: dict[str, list[int]] = {}
        self.items, self.sizes = [i for i, _ in items], []
        for k, (_, text) in enumerate(items):
            words = (text or "").split(" ") if text else []
            grams = [] if len(words) < least_words else {" ".join(words[j : j + window]) for j in range(max(1, len(words) - window + 1))}
            self.sizes.append(len(grams))
            for g in grams:
                owners.setdefault(f" {g} ", []).append(k)
        self.owners = list(owners.values())
        self.search = WuManber(list(owners))

    def matches(self, text: str) -> dict[int, set[int]]:
        found: dict[int, set[int]] = {}
        for i in self.search.find(f" {text} "):
            for k in self.owners[i]:
                found.setdefault(k, set()).add(i)
        return found


_matchers: dict[tuple, Matcher] = {}


def _matcher(sent, window: int, least_words: int) -> Matcher:
    key = (sent.id, window, least_words)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(sent.value, window, least_words)
    return _matchers[key]


class _Sent:
    """A broadcast with an id that stays the same in a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __reduce__(self):
        return _unsent, (self.broadcast, self.id)

    @property
    def value(self):
        return self.broadcast.value


def _unsent(broadcast, key):
    out = _Sent.__new__(_Sent)
    out.broadcast, out.id = broadcast, key
    return out


def passes(benchmark: DataFrame, pass_chars: int = PASS_CHARS) -> list[_Sent]:
    """The normalised items in broadcasts of about pass_chars characters each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normalised("text").alias("plain")).where("plain <> ''")
    chars = items.agg(F.sum(F.length("plain"))).first()[0] or 0
    n = max(1, -(-chars // pass_chars))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "plain"), F.lit(n)) == k)
        out.append(_Sent(spark.sparkContext.broadcast([tuple(r) for r in part.collect()])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, matched, windows): one row for each document row and item that share a
    test string; matched counts the item's distinct test strings found, windows those it has.

    Null and empty texts match nothing; items of fewer than least_words words are no evidence and
    are skipped. Repeated rows and items are reported each, items of equal texts too; null ids stay
    null. An empty table on either side gives no rows. Whole texts are searched; other columns are
    not read. The benchmark is broadcast in parts of a bounded size, each searched in a pass of its
    own; if there are several, the normalised texts are written once, and each pass reads them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("plain"))
    parts = passes(benchmark, pass_chars)
    if len(parts) > 1:
        plain = cut(plain, "plain")
    out = None
    for sent in parts:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _matcher(sent, window, least_words)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    if text:
                        rows += [(doc.as_py(), own.items[k], len(hits), own.sizes[k]) for k, hits in own.matches(text).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["doc_id", "item_id", "matched", "windows"])

        part = plain.mapInArrow(run, RESULT)
        if len(parts) > 1:  # one pass after the other, so that a worker has the tables of one
            part = cut(part, "matches")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs, all columns kept, that contaminated() doesn't report. No shuffle.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops nothing;
    an empty table stays empty. Columns may have any names.
    """
    parts = passes(benchmark, pass_chars)
    left = numbered(docs, normalised("text"))
    if len(parts) > 1:
        left = cut(left, "plain")
    for sent in parts:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _matcher(sent, window, least_words)
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                yield batch.filter(pa.array([not t.is_valid or next(own.search.find(f" {t.as_py()} "), None) is None for t in texts], pa.bool_()))

        left = left.mapInArrow(run, left.schema)
        if len(parts) > 1:
            left = cut(left, "clean")
    return left.drop("last").toDF(*docs.columns)


def sql(window: int = WINDOW, least_words: int = LEAST_WORDS) -> str:
    plain = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split({plain}, ' ') AS w FROM documents WHERE {plain} <> ''),
i AS (SELECT row_number() OVER () AS k, item_id, string_split({plain}, ' ') AS w FROM benchmark WHERE {plain} <> ''),
dg AS (SELECT DISTINCT r, doc_id, array_to_string(w[p:p + {window - 1}], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM d)),
ig AS (SELECT DISTINCT k, item_id, array_to_string(w[p:p + {window - 1}], ' ') AS g FROM (SELECT k, item_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM i WHERE len(w) >= {window})),
sizes AS (SELECT k, count(*) AS n FROM ig GROUP BY k),
hits AS (SELECT r, doc_id, k, item_id, count(*) AS matched, any_value(n) AS windows FROM dg JOIN ig USING (g) JOIN sizes USING (k) GROUP BY r, doc_id, k, item_id
  UNION ALL SELECT r, doc_id, k, item_id, 1, 1 FROM d JOIN i ON len(i.w) >= {least_words} AND len(i.w) < {window} AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' '))
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(windows AS BIGINT) AS windows FROM hits"""
