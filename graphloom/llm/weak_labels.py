"""Quality classifier without labels: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers each vote good, bad or nothing on every document. Documents are
counted by their pattern of votes over the whole corpus; expectation-maximisation over the counts
estimates how often each labeller casts each vote on good and on bad documents, and with it each
pattern's posterior. A hashed linear scorer is trained on the posteriors of at most SAMPLE different
texts chosen by hash, each counted once, however many copies it has, and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import linear
from graphloom.llm.common import Words, windows
from graphloom.llm.quality import blank

SAMPLE = 4_000
KEEP = 0.5
LABELLERS = ("letters", "signs", "repeats", "variety", "word_length", "capitals", "lines", "bars", "length", "dominance", "pairs")
RESULT = "doc_id long, posterior double, score double, keep boolean"


def votes(column: pa.Array) -> np.ndarray:
    """int8 (rows, labellers): 1 good, -1 bad, 0 no vote."""
    words = Words(column)
    n_rows = len(words.count)
    data, offsets = words.data, words.offsets
    size = np.diff(offsets).astype(float)
    row_of_byte = np.repeat(np.arange(n_rows), np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row_of_byte[mask], minlength=n_rows) / np.maximum(size, 1)

    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    space = data <= 32
    sign = ~letter & ~space & ~((data >= 48) & (data <= 57))
    letters, signs, capitals, bars = share(letter), share(sign), share(upper), share((data == 124) | (data == 35) | (data == 37) | (data == 36) | (data == 42) | (data == 38))
    h, rows = words.hashes(), words.rows()
    n = np.maximum(words.count, 1)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    repeats = np.bincount(rows[again], minlength=n_rows) / n

    def distinct_of(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of each row, and how often its most frequent one stands there."""
        if not len(hashes):
            return np.zeros(n_rows, int), np.zeros(n_rows, int)
        order = np.lexsort((hashes, row))
        x, r = hashes[order], row[order]
        begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (r[1:] != r[:-1])])
        most = np.zeros(n_rows, int)
        np.maximum.at(most, r[begin], np.diff(np.r_[begin, len(x)]))
        return np.bincount(r[begin], minlength=n_rows), most

    distinct, most = distinct_of(h, rows)
    inside = rows[:-1] == rows[1:]
    pairs = distinct_of(windows(h, 2)[inside], rows[:-1][inside])[0] / np.maximum(1, words.count - 1)
    # distinct words grow slower than words: about as the power 0.8 of their number
    variety = distinct / n**0.8
    # characters, not bytes; where most stand without spaces, each is a word and none too short or long
    begins = (data & 0xC0) != 0x80
    until = np.r_[0, np.cumsum(begins)]
    word_length = np.bincount(rows, (until[words.end] - until[words.start]).astype(float), n_rows) / n
    wide = np.bincount(row_of_byte[begins & (data >= 0xE3) & (data <= 0xE9)], minlength=n_rows)
    spaced = wide <= 0.3 * np.bincount(row_of_byte[begins], minlength=n_rows)
    count = words.count + wide
    line_ends = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offsets[:-1][size > 0], line_ends[line_ends + 1 < len(data)] + 1])
    line_row = np.searchsorted(offsets, starts, "right") - 1
    at_word = np.r_[np.searchsorted(words.start, starts), len(h)]
    sums = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    lines = np.bincount(line_row, minlength=n_rows)
    dup = 1 - distinct_of(sums[at_word[1:]] - sums[at_word[:-1]], line_row)[0] / np.maximum(lines, 1)
    some = words.count >= 20
    out = np.zeros((n_rows, len(LABELLERS)), np.int8)

    def vote(k: int, good: np.ndarray, bad: np.ndarray) -> None:
        out[:, k] = np.where(bad, -1, np.where(good, 1, 0))

    vote(0, letters > 0.78, some & (letters < 0.65))
    vote(1, signs < 0.04, some & (signs > 0.08))
    vote(2, repeats < 0.02, repeats > 0.1)
    vote(3, variety > 1.2, variety < 0.6)
    vote(4, spaced & (word_length > 3.5) & (word_length < 7), spaced & ((word_length < 2.5) | (word_length > 8.5)))
    vote(5, capitals < 0.05, some & (capitals > 0.2))
    vote(6, dup < 0.05, dup > 0.3)
    vote(7, bars < 0.002, bars > 0.03)
    vote(8, count >= 50, count < 3)
    vote(9, some & (most < 0.12 * n), some & (most > 0.25 * n))
    vote(10, some & (pairs > 0.8), some & (pairs < 0.5))
    out[size == 0] = -1
    return out


def code(v: np.ndarray) -> np.ndarray:
    """One number for each row's votes."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def uncode(c: np.ndarray, k: int = len(LABELLERS)) -> np.ndarray:
    return (c[:, None] // 3 ** np.arange(k) % 3 - 1).astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, rates[class, labeller, vote is good] and the share
    of good documents. No vote says nothing about the class, so short texts aren't held against
    themselves. It starts from the majority of votes, which also says which class is good."""
    total = patterns.sum(1)
    post = np.clip(0.5 + total / (2.0 * np.maximum(1, np.abs(patterns).sum(1))), 0.05, 0.95)
    counts = counts.astype(float)
    n = counts.sum()
    rates, prior = np.zeros((2, patterns.shape[1], 2)), 0.5
    for _ in range(rounds):
        for c, w in ((1, counts * post), (0, counts * (1 - post))):
            for k, vote in enumerate((-1, 1)):
                rates[c, :, k] = ((patterns == vote) * w[:, None]).sum(0) + smooth
            rates[c] /= rates[c].sum(1, keepdims=True)
        prior = ((counts * post).sum() + smooth) / (n + 2 * smooth)
        which = np.arange(patterns.shape[1])
        log = [np.where(patterns != 0, np.log(rates[c, which, (patterns > 0).astype(int)]), 0.0).sum(1) for c in (0, 1)]
        z = log[1] - log[0] + np.log(prior / (1 - prior))
        now = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if len(now) and np.abs(now - post).max() < 1e-9:
            post = now
            break
        post = now
    return post, rates, float(prior)


def vote_counts(docs: DataFrame) -> DataFrame:
    """(pattern, docs): how many documents cast each pattern of votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                value, n = np.unique(code(votes(batch.column(0).slice(at, 500))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], ["pattern", "docs"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, docs long").groupBy("pattern").agg(F.sum("docs").alias("docs"))


def sample_texts(docs: DataFrame, sample: int) -> pa.Table:
    """sample different texts of the smallest hashes, as (text); all of them, if there are fewer.
    Copies are folded where they are read, so a text of many copies is one row of a few."""
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"), F.xxhash64("text", F.lit(5)).alias("mark"))
    different = texts.agg(F.approx_count_distinct("mark")).first()[0]
    # three times as many as are wanted pass, so that the estimate's error never leaves too few
    share = min(1.0, 3 * sample / max(1, different))
    picked = texts.where(F.pmod("mark", F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return picked.groupBy("mark").agg(F.any_value("text").alias("text")).orderBy(F.pmod("mark", F.lit(1 << 40)), "mark").limit(sample).select("text").toArrow()


def quality_classifier(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(doc_id, posterior, score, keep) of each row: the weak-label model's posterior of good, the
    linear scorer's probability, and whether the latter is at least keep.

    Null and blank texts have posterior and score 0. Repeated rows get a row each, null doc_ids
    stay null, an empty table gives no rows. A corpus whose sample has posteriors of one side only
    is scored by its posteriors. Whole texts are read; other columns are not.
    """
    found = vote_counts(docs).collect()  # at most 3 ** labellers rows
    number = np.array([r.pattern for r in found], np.int64)
    counts = np.array([r.docs for r in found], np.int64)
    post, _, _ = expectation_maximisation(uncode(number), counts)
    order = np.argsort(number)
    known, value = number[order], post[order]

    def posterior(column: pa.Array) -> np.ndarray:
        return value[np.searchsorted(known, code(votes(column)))]

    texts = sample_texts(docs, sample).column("text").combine_chunks() if len(found) else pa.array([], pa.string())
    target = np.concatenate([posterior(texts.slice(i, 500)) for i in range(0, len(texts), 500)] or [np.zeros(0)])
    mixed = (target > 0.5).any() and (target <= 0.5).any()
    if mixed:
        good, bad = target.sum(), (1 - target).sum()
        w, b = linear.train(texts, target, share=target * 0.5 / good + (1 - target) * 0.5 / bad)
    else:
        w, b = np.zeros(linear.DIM, np.float32), 0.0
    sent = docs.sparkSession.sparkContext.broadcast((known, value, w, b, bool(mixed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value, w, b, mixed = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                column = part.column(1)
                p = value[np.minimum(np.searchsorted(known, code(votes(column))), len(known) - 1)]
                s = 1 / (1 + np.exp(-np.clip(linear.margins(column, w, b), -40, 40))) if mixed else p
                empty = blank(column)
                p, s = np.round(np.where(empty, 0.0, p), 6), np.round(np.where(empty, 0.0, s), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(s), pa.array(s >= keep)], ["doc_id", "posterior", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
