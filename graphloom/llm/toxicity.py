"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens are mapped to a small alphabet by a lexicon (plain words, and insult roots of four
strengths that match the beginnings of words). Four transducers rewrite and weigh the symbols of a
clause: negation turns an insult or threat within its scope into a harmless symbol, reported speech
marks what follows it, a target (a person addressed or spoken of) turns a threat verb into a threat
and strengthens insults, and the last one weighs what is left. They are composed into one machine
once, and only clauses that hold an insult or a threat verb are run through it. A document is toxic if
one clause scores THRESHOLD, or the clauses of some stretch of REACH words do so together. What else
the document holds, before, after or between, makes no difference, however long it is.

Insult roots come from the labelled rows: beginnings of words that are much more frequent in toxic
than in other documents, by a likelihood-ratio test. Of either label at most SAMPLE_TOXIC and
SAMPLE_CLEAN documents are used, chosen by hash. Without labels the built-in English list is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Words, numbered, prefix_hash

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 12_000
THRESHOLD = 3.0
#: words within which the scores of clauses add up
REACH = 50
LEAST_RATIO, LEAST_EVIDENCE = 2.0, 25.0
SIZES = range(4, 9)

INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting trash clown imbecile dumbass asshole bastard bitch vermin subhuman degenerate".split()
THREATS = "kill murder hurt stab shoot strangle beat burn destroy hunt hang umbringen töten tuer frapper matar".split()
TARGETS = "you your you're youre u he she him her they them his their these those people du dich dein ihr euch tu toi te vous votre usted ustedes vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine jamais nunca".split()
REPORTS = "said says wrote writes claimed claims quoted reported reports called alleged sagte schrieb dit écrit dijo escribió".split()

O, I1, I2, I3, I4, V, G, N, R = range(9)  # other, insults by strength, threat verb, target, negation, report
RI1, RI2, RI3, RI4, RV, TH, RTH = range(9, 16)  # reported insults and threat verb, threat, reported threat
ALPHABET = 16


@dataclass
class Transducer:
    """arcs[state][symbol] = (output, weight, next state); a missing arc copies its symbol at no weight
    and stays. State 0 begins, all states end."""

    arcs: list[dict[int, tuple[int, float, int]]] = field(default_factory=list)

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs[state].get(symbol, (symbol, 0.0, state))

    def compose(self, other: Transducer) -> Transducer:
        """Reads as self, writes as other reading what self writes; weights add up."""
        index, out, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = {}
            for s in range(ALPHABET):
                mid, w1, a2 = self.step(a, s)
                end, w2, b2 = other.step(b, mid)
                if (a2, b2) not in index:
                    index[a2, b2] = len(index)
                    todo.append((a2, b2))
                row[s] = (end, w1 + w2, index[a2, b2])
            out.append(row)
        return Transducer(out)

    def weight(self, symbols) -> float:
        state = total = 0
        for s in symbols:
            _, w, state = self.step(state, s)
            total += w
        return total


def negation(scope: int = 3) -> Transducer:
    """Within scope tokens after a negation, insults and threat verbs are plain words."""
    arcs = [{N: (O, 0.0, 1)}]
    for k in range(1, scope + 1):
        after = 0 if k == scope else k + 1
        row = {s: (s, 0.0, after) for s in (O, G, R)}
        row |= {s: (O, 0.0, after) for s in (I1, I2, I3, I4, V)}
        arcs.append(row | {N: (O, 0.0, 1)})
    return Transducer(arcs)


def reported() -> Transducer:
    """After a verb of saying, insults and threats are those of someone else."""
    return Transducer([{R: (O, 0.0, 1)}, {R: (O, 0.0, 1), I1: (RI1, 0.0, 1), I2: (RI2, 0.0, 1), I3: (RI3, 0.0, 1), I4: (RI4, 0.0, 1), V: (RV, 0.0, 1)}])


def targeted(reach: int = 4) -> Transducer:
    """A threat verb with a target at most reach tokens later is a threat, at the target's place."""
    arcs = [{V: (O, 0.0, 1), RV: (O, 0.0, reach + 1)}]
    for kind, (symbol, base) in enumerate(((TH, 1), (RTH, reach + 1))):
        for k in range(reach):
            after = 0 if k == reach - 1 else base + k + 1
            row = {s: (s, 0.0, after) for s in range(ALPHABET)}
            arcs.append(row | {G: (symbol, 0.0, 0), V: (O, 0.0, 1), RV: (O, 0.0, reach + 1)})
    return Transducer(arcs)


def weighing(bonus: float = 0.5, report: float = 0.25, threat: float = 4.0) -> Transducer:
    """Insults weigh their strength, a quarter when reported; a target in the clause before or
    after one adds a bonus once."""
    insults = {I1: 1.0, I2: 2.0, I3: 3.0, I4: 4.0}
    quoted = {RI1: report, RI2: 2 * report, RI3: 3 * report, RI4: 4 * report}
    threats = {TH: threat, RTH: threat * report}

    def row(add: float, after: int) -> dict:
        return {s: (O, w + add, after) for s, w in insults.items()} | {s: (O, w, after) for s, w in quoted.items()} | {s: (O, w, 3) for s, w in threats.items()}

    # 0: nothing yet, 1: target seen, 2: insult seen without target, 3: both seen
    return Transducer([row(0.0, 2) | {G: (O, 0.0, 1)}, row(bonus, 3) | {G: (O, 0.0, 1)}, row(0.0, 2) | {G: (O, bonus, 3)}, row(0.0, 3) | {G: (O, 0.0, 3)}])


def grammar() -> Transducer:
    return negation().compose(reported()).compose(targeted()).compose(weighing())


def builtin() -> dict[str, int]:
    return {w: 4 for w in INSULTS}


def sampled(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic) of labelled documents, at most so many of either label, chosen by hash."""
    picked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    parts = [picked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    # the sample's ids have a bounded number of rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("text", "toxic")


def learned(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> dict[str, int]:
    """Roots and strengths from 1 to 4: the built-in list and beginnings of words that tell the
    labelled toxic documents from the others."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # document frequencies of a batch, so that the shuffle holds each root once a batch
        import re

        word = re.compile(r"[^\W_]+")
        for batch in batches:
            counts: dict[str, list[int]] = {}
            n = [0, 0]
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[t] += 1
                found: set[str] = set()
                for w in set(word.findall(text or "")):
                    found.update(w[:k] for k in SIZES if len(w) >= k)
                for root in found:
                    counts.setdefault(root, [0, 0])[t] += 1
            counts[""] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["root", "t", "c"])

    sums = sampled(docs, labels, toxic, clean).select(F.lower("text").alias("text"), "toxic").mapInArrow(spread, "root string, t long, c long").groupBy("root").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    one = sums.where("root = ''").select(F.col("t").alias("tt"), F.col("c").alias("cc"))
    t, c, tt, cc = (F.col(x).cast("double") for x in ("t", "c", "tt", "cc"))
    ratio = F.log((t + 0.5) / (tt + 1)) - F.log((c + 0.5) / (cc + 1))
    et, ec = (t + c) * tt / (tt + cc), (t + c) * cc / (tt + cc)
    evidence = 2 * (t * F.log(t / et) + F.when(c > 0, c * F.log(c / ec)).otherwise(0.0))
    found = sums.where("root <> '' and t >= 4").crossJoin(F.broadcast(one)).where("cc > 0").where((ratio >= LEAST_RATIO) & (evidence >= LEAST_EVIDENCE)).select("root", "t", "c", ratio.alias("ratio")).collect()
    own = roots([tuple(r) for r in found])
    return own | builtin()


def roots(found: list[tuple[str, int, int, float]]) -> dict[str, int]:
    """The roots to keep of (root, toxic documents, other documents, log ratio): the longest of
    those as frequent, none that a shorter one explains about as well."""
    kept: dict[str, tuple[int, float]] = {}
    for root, t, _, ratio in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        shorter = [kept[root[:k]] for k in range(1, len(root)) if root[:k] in kept]
        longer = [x for x in kept if x.startswith(root)]
        if any(r >= ratio - 1 for _, r in shorter) or any(kept[x][0] >= 0.97 * t and kept[x][1] >= ratio for x in longer):
            continue
        kept[root] = (t, ratio)
    return {root: int(min(4, max(1, ratio // 1.6))) for root, (_, ratio) in kept.items()}


class Scorer:
    """Scores batches of lower-case texts with a lexicon of roots."""

    def __init__(self, lexicon: dict[str, int]):
        arcs = grammar().arcs
        self.next = [[arcs[s][k][2] for k in range(ALPHABET)] for s in range(len(arcs))]
        self.gain = [[arcs[s][k][1] for k in range(ALPHABET)] for s in range(len(arcs))]
        by_size: dict[int, dict[int, int]] = {}
        for root, strength in lexicon.items():
            by_size.setdefault(len(root.encode()), {})[prefix_hash(root.encode())] = strength
        for verb in THREATS:
            by_size.setdefault(-len(verb.encode()), {})[prefix_hash(verb.encode())] = V
        self.by_size = {k: (np.array(sorted(v), np.uint64), np.array([v[h] for h in sorted(v)], np.int8)) for k, v in by_size.items()}
        self.words = {w.encode(): s for s, ws in ((G, TARGETS), (N, NEGATIONS), (R, REPORTS)) for w in ws}

    def classes(self, words: Words) -> np.ndarray:
        """Insult strength or threat verb of each word, 0 for all others."""
        out = np.zeros(len(words), np.int8)
        length = words.end - words.start
        for size, (known, value) in sorted(self.by_size.items()):
            which, h = words.prefix_hashes(abs(size))
            if size < 0:
                whole = length[which] == -size
                which, h = which[whole], h[whole]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out[which[hit]] = np.maximum(out[which[hit]], value[at[hit]])
        return out

    def clause(self, data: bytes, words: Words, base: int, i: int, j: int, classes: np.ndarray) -> float:
        state, score = 0, 0.0
        for k in range(i, j):
            s = int(classes[k])
            if not s:
                w = data[words.start[k] - base : words.end[k] - base]
                # the apostrophe splits words: don't is read as don, t
                s = self.words.get(w, N if w in (b"don", b"isn", b"aren", b"wasn", b"didn", b"doesn", b"won", b"can") and data[words.end[k] - base : words.end[k] - base + 2] == b"'t" else O)
            score += self.gain[state][s]
            state = self.next[state][s]
        return score

    def score(self, column: pa.Array) -> list[tuple[int, float, int, float]]:
        """(row, score, clauses that score, the largest sum within REACH words) of the rows with a
        scoring clause."""
        words = Words(column, letters_only=True)
        classes = self.classes(words)
        hits = np.flatnonzero(classes)
        rows = np.searchsorted(words.first, hits, "right") - 1
        out = []
        for row in np.unique(rows):
            own = hits[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
            lo, hi = int(words.offsets[row]), int(words.offsets[row + 1])
            raw = words.data[lo:hi]
            stops = np.flatnonzero((raw == 46) | (raw == 33) | (raw == 63) | (raw == 59) | (raw == 10)) + lo
            data = raw.tobytes()
            a, b = words.first[row], words.first[row + 1]
            cuts = np.r_[a, np.searchsorted(words.start[a:b], stops) + a, b]
            which, at = np.unique(np.searchsorted(cuts, own, "right"), return_index=True)
            scores = np.array([self.clause(data, words, lo, cuts[k - 1], cuts[k], classes) for k in which.tolist()])
            good = np.flatnonzero(scores > 0)
            if len(good):
                gained, places = scores[good], own[at[good]]
                sums = np.r_[0.0, np.cumsum(gained)]
                most = (sums[1:] - sums[np.searchsorted(places, places - REACH, "right")]).max()
                out.append((int(row), float(sums[-1]), len(good), float(most)))
        return out

    def toxic(self, column: pa.Array) -> list[tuple[int, float, int]]:
        """(row, score, clauses) of the rows that are toxic."""
        return [(row, s, n) for row, s, n, most in self.score(column) if most >= THRESHOLD - 1e-9]


_scorers: dict[tuple, Scorer] = {}


def _scorer(lexicon: tuple) -> Scorer:
    if lexicon not in _scorers:
        _scorers.clear()
        _scorers[lexicon] = Scorer(dict(lexicon))
    return _scorers[lexicon]


def toxic_documents(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """(doc_id, score, clauses, toxic) of the rows that are toxic, toxic being always true.

    The score is the sum over all clauses; a score of just THRESHOLD within REACH words is toxic.
    Null and empty texts are never toxic. Repeated rows are reported each, null doc_ids stay null,
    an empty table gives no rows. Whole texts are scored; other columns are not read.
    """
    given = tuple(sorted(lexicon.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(given)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = own.toxic(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([round(s, 4) for _, s, _ in found], pa.float64()), pa.array([n for _, _, n in found], pa.int64()), pa.array([True] * len(found), pa.bool_())], ["doc_id", "score", "clauses", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(run, "doc_id long, score double, clauses long, toxic boolean")


def drop_toxic(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """The rows of docs, all columns kept, that aren't toxic. No shuffle.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty. Columns
    may have any names.
    """
    given = tuple(sorted(lexicon.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(given)
        for batch in batches:
            n = batch.num_columns - 1
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, _, _ in own.toxic(part.column(n))]] = False
                yield part.select(range(n)).filter(pa.array(keep))

    given_rows = numbered(docs, F.lower(F.col("text").cast("string")))
    return given_rows.mapInArrow(run, given_rows.drop("last").schema).toDF(*docs.columns)
