"""Mixing sources to target weights by fitting each source's token budget as a subset sum.

Documents are counted by source and exact token length. For each source the proportional share of
every length is taken, single documents of seeded lengths bring the rest of the budget down to at
most twice the longest length, and a bounded-knapsack dynamic programme over the documents left
finds lengths that fill it, exactly wherever some subset does. Within a length the documents are
chosen by a seeded hash. Only lengths and counts reach the programme, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import UID, every, fresh, with_uid
from graphloom.llm.tokenizer import VOCABULARY, tokenizer
from graphloom.storage import cut, scratch

ALPHA = 0.7
FRACTION = 0.9
SEED = 17


def fit_budget(lengths, counts, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take, so that their tokens sum up to at most budget.

    Takes all where they fit. The sum falls short of the budget only if the documents beyond the
    proportional share have no subset that fills the rest.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros_like(counts)
    take = np.array([int(c) * int(budget) // total for c in counts], np.int64)
    rest = int(budget - (lengths * take).sum())
    reserve = 2 * int(lengths.max())
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        if rest <= reserve:
            break
        if take[i] < counts[i]:
            take[i] += 1
            rest -= int(lengths[i])
    full, reach, items, seen = (1 << (rest + 1)) - 1, 1, [], [1]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        left, n, k = min(int(counts[i] - take[i]), rest // max(1, int(lengths[i]))), int(lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            k = min(k, left)
            items.append((i, k))
            reach |= reach << n * k & full
            seen.append(reach)
            left, k = left - k, 2 * k
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(seen[:-1])):
        if not before >> at & 1:
            take[i] += k
            at -= int(lengths[i]) * k
    return take


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Row key, doc_id, source and token length of each row, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([own.count(t.as_py() or "") for t in b.column(3)], pa.int64())], [UID, "doc_id", "source", "n_tokens"])

    part = docs.select(UID, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return part.mapInArrow(run, f"{UID} long, doc_id long, source string, n_tokens long")


def _fill(sums: DataFrame, fraction: float) -> DataFrame:
    """(key, budget) of fraction of all tokens, shared out by weight: sources smaller than their
    share are whole, and what they leave goes to the others, until none is smaller."""
    sums = cut(sums)
    total, level, sources = None, None, None
    while True:
        above = sums if level is None else sums.where(F.col("tokens") > F.lit(level) * F.col("weight"))
        n, tokens, weight = above.agg(F.count("*"), F.sum("tokens"), F.sum("weight")).first()
        total = tokens if total is None else total
        if not n or n == sources:
            break
        level, sources = (fraction * total - (total - tokens)) / weight, n
    share = F.col("tokens") if not n else F.least("tokens", F.lit(level) * F.col("weight"))
    return sums.select("key", F.floor(share).cast("long").alias("budget"))


def select_rows(keyed: DataFrame, weights: dict | None = None, alpha: float = ALPHA, fraction: float = FRACTION, budget: int | None = None, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row key, doc_id, source, n_tokens) of the rows of keyed that are chosen; see mix_sources."""
    spark = keyed.sparkSession
    where = scratch(spark, "lengths")
    # a null source has a key that no named source can have
    token_lengths(keyed, vocabulary).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).write.parquet(where)
    rows = spark.read.parquet(where).where("n_tokens > 0")
    histogram = rows.groupBy("key", "n_tokens").agg(F.count("*").alias("docs"))
    sums = histogram.groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("docs")).cast("double").alias("tokens"))
    if weights is None:
        sums = sums.withColumn("weight", F.pow("tokens", F.lit(alpha)))
    else:
        given = spark.createDataFrame([("n" if k is None else "s" + k, float(w)) for k, w in weights.items()], "key string, weight double")
        sums = sums.join(given, "key")
    sums = sums.where("weight > 0")
    if weights is None and budget is None:
        budgets = _fill(sums, fraction)
    else:
        whole = sums.agg(F.sum("weight").alias("all_weight"), F.min(F.col("tokens") / F.col("weight")).alias("least"))
        room = F.lit(float(budget)) if budget is not None else F.lit(fraction) * F.col("least") * F.col("all_weight")
        budgets = sums.crossJoin(F.broadcast(whole)).select("key", F.floor(room * F.col("weight") / F.col("all_weight")).cast("long").alias("budget"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_tokens")
        own = seed + int.from_bytes(part.key.iloc[0].encode()[-6:], "little")
        part["take"] = fit_budget(part.n_tokens, part.docs, int(part.budget.iloc[0]), own)
        return part[["key", "n_tokens", "take"]]

    # one group for each source: as many rows as it has distinct lengths
    plan = histogram.join(budgets, "key").groupBy("key").applyInPandas(fit, "key string, n_tokens long, take long").where("take > 0")
    order = Window.partitionBy("key", "n_tokens").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", UID)
    chosen = rows.join(plan, ["key", "n_tokens"]).withColumn("__gl_rank", F.row_number().over(order)).where(F.col("__gl_rank") <= F.col("take"))
    return chosen.select(UID, "doc_id", "source", "n_tokens")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents chosen.

    weights: target share of each source by name (None: the null source); sources not named are
    left out. Without it, a source's weight is its tokens to the power alpha. budget: tokens of the
    whole mix; a source smaller than its share is then taken whole and not made up for by others.
    With neither, the mix is fraction of all tokens: sources smaller than their share are taken
    whole, and the rest is shared out among the others, so a small source holds back no other. With
    weights only, it is fraction times the largest mix that no source is too small for. Documents without tokens
    (null and empty texts) are never chosen. Repeated rows are separate documents; equal hashes are
    settled by doc_id, then by place. An empty table gives no rows. Other columns are not read.
    """
    return select_rows(with_uid(docs.select("doc_id", "source", "text")), **options).drop(UID)


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns kept, that mix_sources() chooses; each row at most once, so
    repeated rows stay as often as they are chosen. Rows with null or empty texts go. An empty table
    stays empty."""
    key = fresh(docs.columns)
    keyed = with_uid(docs, key)
    chosen = select_rows(keyed.select(F.col(key).alias(UID), "doc_id", "source", "text"), **options).select(F.col(UID).alias(key))
    return keyed.join(chosen, key, "left_semi").select(*every(docs.columns))
