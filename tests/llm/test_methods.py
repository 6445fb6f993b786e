"""The operators against brute force, exact round trips and held-out labels."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality, registry, substring_dedup, token_counts, token_output, toxicity, weak_labels
from graphloom.llm.common import UID, Words, file_bits, path_hash, windows, with_uid
from graphloom.llm.tokenizer import tokenizer
from graphloom.storage import scratch

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# 1

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=12), st.text("abc", max_size=80))
def test_wu_manber_finds_all_occurrences(patterns, text):
    patterns = list(dict.fromkeys(patterns))
    want = Counter(p for p in patterns for i in range(len(text)) if text.startswith(p, i))
    assert Counter(patterns[i] for i in decontaminate.WuManber(patterns).find(text)) == want


def test_decontaminate_in_passes_is_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    assert one and one == sorted(map(tuple, decontaminate.contaminated(docs, bench, pass_chars=3000).collect()))
    gone = {d for d, *_ in one}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).select("doc_id").collect()} == set(range(docs.count())) - gone


# 2

@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab, .'\n\t  é東1!"), max_size=60))
def test_chunked_tokens_are_the_encodings_own(text):
    own = tokenizer()
    want = own.encode(text)
    assert own.ids(text).tolist() == want and own.count(text) == len(want)


def test_counts_against_encoding(spark):
    got = registry.op2_token_counts(spark, SF)
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(tokenizer().encode(r.text))
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in got.collect()} == want


def test_ledger_applies_each_batch_once(spark):
    ledger = token_counts.Ledger(spark, scratch(spark, "ledger"))
    row = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
    first = spark.createDataFrame([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, "en", "v1", 7)], row)
    assert ledger.apply("b1", token_counts.inserts(first)) and not ledger.apply("b1", token_counts.inserts(first))
    assert ledger.apply("b2", token_counts.revisions(first.where("doc_id = 2"), spark.createDataFrame([(2, "b", "en", "v1", 6)], row)))
    assert ledger.apply("b3", token_counts.deletes(first.where("doc_id = 3")))
    assert ledger.apply("b4", token_counts.inserts(spark.createDataFrame([(1, "a", "en", "v2", 8)], row)))
    assert ledger.applied("b3") and not ledger.applied("b9")
    again = token_counts.Ledger(spark, ledger.path)
    n, last = again._last()
    assert n == 4 and last["batch"] == "b4" and not again._create("commits/0000000003", {})
    # a job that died between its manifest and its mark counts as applied
    again._fs.delete(again._path(f"{again.path}/applied/{last['key']}"), False)
    assert not again.apply("b4", token_counts.inserts(first))
    assert sorted(map(tuple, again.totals().collect())) == [("a", "en", "v1", 1, 10), ("a", "en", "v2", 1, 8), ("b", "en", "v1", 1, 6)]


# 3

def maximal(a, b, least):
    """All maximal exact repeats of word lists, by trying all pairs of places."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


def test_repeats_against_brute_force():
    for seed in range(12):
        r = random.Random(seed)
        word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
        shared = [[word() for _ in range(r.randint(20, 90))] for _ in range(3)]
        a = sum(([word() for _ in range(r.randint(5, 60))] + s for s in shared), [])
        b = sum(([word() for _ in range(r.randint(5, 60))] + s for s in r.sample(shared, 3)), [word()])
        got = set(substring_dedup.repeats(" ".join(a), " \n".join(b)))
        assert got == maximal(a, b, substring_dedup.LEAST)


def test_repeated_words_stay_cheap():
    got = substring_dedup.repeats("la " * 4000, "la " * 3000)
    assert got and len(got) < 5 and all(n >= substring_dedup.LEAST for _, _, n in got)


def test_passages_of_a_corpus(spark):
    got = registry.op3_substring_dedup(spark, SF2).collect()
    text = {k: v.split() for k, v in texts(spark, SF2).items()}
    covered, first, need = defaultdict(set), {}, defaultdict(set)
    for x in got:
        a, b = text[x.doc_id], text[x.ref_doc_id]
        assert a[x.start : x.start + x.words] == b[x.ref_start : x.ref_start + x.words] and x.words >= 50
        assert x.start == 0 or x.ref_start == 0 or a[x.start - 1] != b[x.ref_start - 1]
        e, f = x.start + x.words, x.ref_start + x.words
        assert e == len(a) or f == len(b) or a[e] != b[f]
        covered[x.doc_id] |= set(range(x.start, e))
        covered[x.ref_doc_id] |= set(range(x.ref_start, f))
    for i, w in text.items():
        for k in range(len(w) - 49):
            d, p = first.setdefault(tuple(w[k : k + 50]), (i, k))
            if d != i:
                need[i] |= set(range(k, k + 50))
                need[d] |= set(range(p, p + 50))
    assert all(covered[i] for i in need)
    assert sum(len(v & covered[i]) for i, v in need.items()) >= 0.99 * sum(map(len, need.values()))


def test_passages_behind_boilerplate(spark):
    """Copies of pieces of 49 words before, between and after: the whole passages must still be met."""
    p = [f"p{i}" for i in range(60)]
    rows = [p[:49], p[11:], p, p[:49], p[11:], p]
    docs = [(k, " ".join([f"a{k}x{i}" for i in range(7 * k)] + x + [f"z{k}x{i}" for i in range(5)])) for k, x in enumerate(rows)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert [tuple(r) for r in got] == [(5, 35, 60, 2, 14)]


def test_every_word_of_shared_passages_is_reported(spark):
    need, covered = defaultdict(set), defaultdict(set)
    docs, first = texts(spark, SF2), {}
    for r in registry.op3_substring_dedup(spark, SF2).collect():
        covered[r.doc_id] |= set(range(r.start, r.start + r.words))
        covered[r.ref_doc_id] |= set(range(r.ref_start, r.ref_start + r.words))
    for i, text in docs.items():
        w = text.split()
        for k in range(len(w) - 49):
            d, at = first.setdefault(tuple(w[k : k + 50]), (i, k))
            if d != i:
                need[i] |= set(range(k, k + 50))
                need[d] |= set(range(at, at + 50))
    assert need and all(v <= covered[i] for i, v in need.items())


def test_packed_windows_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 2000))
        rows = np.sort(rng.integers(0, 40, n))
        at = np.concatenate([np.sort(rng.choice(200_000, (rows == r).sum(), replace=False)) for r in np.unique(rows)])
        ids = np.unique(rng.integers(0, 1 << int(rng.integers(8, 62)), 400))
        uid = np.r_[ids, ids[-1] + 1 + np.arange(40)][rows]
        h, bucket = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 7, n).astype(np.int32)
        got = [(b, *map(int, x)) for b, *blobs in substring_dedup._packed(bucket, h, uid, at) for x in zip(*substring_dedup._unpacked(*blobs))]
        cut_off = np.uint64((1 << 8 * substring_dedup.KEY_BYTES) - 1)
        assert sorted(got) == sorted((int(b), int(k & cut_off), int(u), int(a)) for b, k, u, a in zip(bucket, h, uid, at))


def test_passages_against_brute_force_over_batches(spark):
    """Every window of a later row lies in a repeat with the first row that has it, and repeats are
    maximal, however the rows fall into batches; boilerplate and periodic texts included."""
    r = random.Random(31)
    parts = [[f"p{k}w{i}" for i in range(r.randint(20, 120))] for k in range(12)] + [["la"] * 130]
    rows = []
    for k in range(120):
        row = []
        for _ in range(r.randint(1, 4)):
            part = r.choice(parts)
            a = r.randrange(len(part))
            row += part[a // 3 :] if r.random() < 0.7 else part[: a + 1]
            row += [f"x{k}y{i}" for i in range(r.randint(0, 3))]
        rows.append((k, " ".join(row)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = {k: t.split() for k, t in rows}
    held = set()
    for x in got:
        a, b, e, f = text[x.doc_id], text[x.ref_doc_id], x.start + x.words, x.ref_start + x.words
        assert x.ref_doc_id < x.doc_id and a[x.start : e] == b[x.ref_start : f] and len(a[x.start : e]) == x.words >= 50
        assert x.start == 0 or x.ref_start == 0 or a[x.start - 1] != b[x.ref_start - 1]
        assert e == len(a) or f == len(b) or a[e] != b[f]
        held |= {(x.doc_id, x.ref_doc_id, i) for i in range(x.start, e - 49)}
    first = {}
    for k, w in text.items():
        for i in range(len(w) - 49):
            d = first.setdefault(tuple(w[i : i + 50]), k)
            assert d == k or (k, d, i) in held
    assert len(got) == len(set(map(tuple, got))) and len(got) > 60


def test_hot_passage_costs_no_pairs(spark):
    """One passage in 100,000 rows: each but the first is linked to the first, once."""
    passage = " ".join(f"h{i}" for i in range(60))
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), F.col("id"), F.lit(" " + passage + " z"), F.col("id")).alias("text"))
    got = substring_dedup.repeated_passages(df)
    row = got.agg(F.count("*"), F.countDistinct("doc_id"), F.countDistinct("ref_doc_id"), F.min("words"), F.max("words"), F.min("start"), F.max("ref_start")).first()
    assert tuple(row) == (99_999, 99_999, 1, 60, 60, 1, 1)


# 4

def test_votes_count_characters():
    """Plain prose in scripts of more bytes a letter, or without spaces, gets no bad vote for lengths."""
    russian = "Вечером мы вышли из дома и долго гуляли вдоль тихой реки, где старые деревья склонялись над водой. " * 4
    chinese = "傍晚我们离开家，沿着安静的河边走了很久，老树在水面上低垂。" * 6
    v = weak_labels.votes(pa.array([russian, chinese]))
    assert (v[:, [weak_labels.LABELLERS.index("word_length"), weak_labels.LABELLERS.index("length")]] >= 0).all()


def test_sample_is_of_different_texts(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("text")
    mark = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40))
    low = docs.orderBy(mark).limit(1).crossJoin(spark.range(20_000)).select("text")
    both = docs.unionByName(low)
    got = weak_labels.sample_texts(both, 200).column("text").to_pylist()
    assert len(got) == len(set(got)) == 200 and got == weak_labels.sample_texts(docs, 200).column("text").to_pylist()
    assert len(weak_labels.sample_texts(both, 10**6)) == docs.distinct().count()


def test_em_recovers_labellers():
    r = np.random.default_rng(3)
    n, truth = 40_000, None
    truth = r.random(n) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    cast = r.random((n, 5)) < 0.8
    right = r.random((n, 5)) < accuracy
    votes = np.where(cast, np.where(right == truth[:, None], 1, -1), 0)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates, prior = weak_labels.expectation_maximisation(patterns, counts)
    assert abs(prior - 0.7) < 0.03 and np.abs((rates[1, :, 1] + rates[0, :, 0]) / 2 - accuracy).max() < 0.03
    majority = ((votes.sum(1) > 0) == truth).mean()
    assert ((post[where.ravel()] > 0.5) == truth).mean() > majority


def test_classifier_agrees_with_labels(spark):
    got = registry.op4_quality_classifier(spark, SF2).join(spark.read.parquet(f"{SF2}/labels.parquet"), "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality], [r.keep for r in got if not r.quality]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def plain_votes(text):
    """The labellers' votes on one text, from their definitions."""
    b, words = text.encode(), text.split() if text.isascii() else [w.decode() for w in re.findall(rb"[^\x00-\x20]+", text.encode())]
    if not b:
        return [-1] * len(weak_labels.LABELLERS)
    letter = [65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in b]
    sign = [not (y or c <= 32 or 48 <= c <= 57) for c, y in zip(b, letter)]
    letters, signs, capitals, bars = (sum(x) / len(b) for x in (letter, sign, [65 <= c <= 90 for c in b], [c in b"|#%$*&" for c in b]))
    n, counts = max(1, len(words)), Counter(words)
    repeats = sum(x == y for x, y in zip(words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    variety, most, length = len(counts) / n**0.8, max(counts.values(), default=0), sum(map(len, words)) / n
    wide = sum(0xE3 <= x.encode()[0] <= 0xE9 for x in text)
    spaced, size = wide <= 0.3 * len(text), len(words) + wide
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    dup = 1 - len({tuple(sorted(x.split())) for x in lines}) / max(1, len(lines))
    some = len(words) >= 20
    both = [
        (letters > 0.78, some and letters < 0.65), (signs < 0.04, some and signs > 0.08), (repeats < 0.02, repeats > 0.1), (variety > 1.2, variety < 0.6),
        (spaced and 3.5 < length < 7, spaced and (length < 2.5 or length > 8.5)), (capitals < 0.05, some and capitals > 0.2), (dup < 0.05, dup > 0.3), (bars < 0.002, bars > 0.03),
        (size >= 50, size < 3), (some and most < 0.12 * n, some and most > 0.25 * n), (some and pairs > 0.8, some and pairs < 0.5),
    ]
    return [-1 if bad else 1 if good else 0 for good, bad in both]


def test_posteriors_against_brute_force(spark):
    """The query's posteriors, from votes taken text by text and an estimation over single documents."""
    rows = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect()
    votes = np.array([plain_votes(r.text or "") for r in rows])
    post, _, _ = weak_labels.expectation_maximisation(votes, np.ones(len(rows), int))
    want = {r.doc_id: p if (r.text or "").strip() else 0.0 for r, p in zip(rows, post)}
    got = registry.op4_quality_classifier(spark, SF2).collect()
    assert len(got) == len(rows) and max(abs(r.posterior - want[r.doc_id]) for r in got) < 1e-5
    assert all(r.keep == (r.score >= weak_labels.KEEP) for r in got)


# 5

@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_line_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF2}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF2)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    rows = [(k // 2, "\n".join(r.choice("abcd ") for _ in range(r.randint(0, 9)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seen, want = set(), []
    for doc, text in sorted(rows, key=lambda x: x[0]):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            g = tuple(x.strip(" ") for x in lines[i : i + 3])
            if any(g):
                if g in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(g)
        want.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    assert sorted(map(tuple, line_dedup.line_dedup(df).collect())) == sorted(want)


# 6

def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF2}/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.quality_rules(docs, fit).join(held, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in got) >= 0.95 * len(got)
    p, y = np.array([r.probability for r in got]), np.array([r.quality for r in got])
    assert np.mean((p - y) ** 2) < 0.05 and abs(p.mean() - y.mean()) < 0.05


# 7

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=7), st.integers(0, 200))
def test_budget_fit(histogram, budget):
    lengths, counts = list(histogram), list(histogram.values())
    take = mixing.fit_budget(lengths, counts, budget)
    got = int((np.array(lengths) * take).sum())
    assert (take >= 0).all() and (take <= counts).all() and got <= max(0, budget)
    # all subset sums of what the proportional share leaves
    total = sum(a * b for a, b in histogram.items())
    if total > budget:
        base = [c * budget // total for c in counts]
        sums = {0}
        for length, c, b in zip(lengths, counts, base):
            sums = {s + k * length for s in sums for k in range(c - b + 1)}
        floor = sum(a * b for a, b in zip(lengths, base))
        if budget - floor <= 2 * max(lengths):
            assert got == floor + max(s for s in sums if s <= budget - floor)


def test_mix_hits_its_targets(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    lengths = {r.doc_id: (r.source, len(tokenizer().encode(r.text))) for r in docs.collect()}
    got = mixing.mix_sources(docs, weights={"src0": 2, "src1": 1}, budget=30_000).collect()
    assert all(lengths[r.doc_id] == (r.source, r.n_tokens) for r in got) and len({r.doc_id for r in got}) == len(got)
    sums = Counter()
    for r in got:
        sums[r.source] += r.n_tokens
    assert 19_980 <= sums["src0"] <= 20_000 and 9_980 <= sums["src1"] <= 10_000
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(5), weights={"src0": 2, "src1": 1}, budget=30_000).collect())
    assert sorted(got) != sorted(mixing.mix_sources(docs, weights={"src0": 2, "src1": 1}, budget=30_000, seed=4).collect())


def test_small_sources_hold_back_no_other(spark):
    docs = [(k, name, " ".join(f"w{(k * 7 + i) % 97}" for i in range(20 + k % 30))) for k, name in enumerate(["big"] * 300 + ["mid"] * 60 + ["few"] * 6)]
    stray = [(9000, None, "one short stray text"), (9001, "dot", "and another")]
    schema = "doc_id long, source string, text string"
    lengths = {d: len(tokenizer().encode(x)) for d, _, x in docs + stray}
    for rows in (docs, docs + stray):
        got = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
        total, kept = sum(lengths[d] for d, _, _ in rows), Counter()
        for r in got:
            kept[r.source] += r.n_tokens
        whole = {name: sum(lengths[d] for d, s, _ in rows if s == name) for name in {s for _, s, _ in rows}}
        assert 0.9 * total - 8 <= sum(kept.values()) <= 0.9 * total
        assert kept["big"] < whole["big"] and all(kept[s] == n for s, n in whole.items() if s != "big")


def test_budgets_by_hand(spark):
    """900 tokens give 112.5 a unit of weight; a and c are smaller, which leaves 700 for 5 units."""
    sums = spark.createDataFrame([("a", 10.0, 1.0), ("b", 150.0, 1.0), ("c", 190.0, 2.0), ("d", 650.0, 4.0)], "key string, tokens double, weight double")
    assert {r.key: r.budget for r in mixing._fill(sums, 0.9).collect()} == {"a": 10, "b": 140, "c": 190, "d": 560}
    assert {r.key: r.budget for r in mixing._fill(sums, 1.0).collect()} == {"a": 10, "b": 150, "c": 190, "d": 650}


# 8

@pytest.mark.parametrize("text,hit", [
    ("you are an idiot", True), ("he is not an idiot", False), ("she said he is an idiot", False), ("i will kill you", True), ("kill the process", False),
    ("i won't kill you", False), ("what a moron. thanks", True), ("they never kill them", False), ("no problem here, you loser", True), ("you are no loser", False), ("fine. you pathetic loser", True),
])
def test_grammar(text, hit):
    assert bool(toxicity.Scorer(toxicity.builtin()).toxic(pa.array([text]))) is hit


def test_padding_hides_nothing():
    clauses = "you idiot. what a moron."
    scorer = toxicity.Scorer({"idiot": 2, "moron": 2})
    harmless = " The weather was fine and we walked along the river." * 140
    for text in (clauses, clauses + harmless, harmless + " " + clauses, harmless + " " + clauses + harmless):
        assert [x[0] for x in scorer.toxic(pa.array([text.lower()]))] == [0]
    apart = ("you idiot." + harmless + " what a moron.").lower()
    assert not scorer.toxic(pa.array([apart])) and scorer.score(pa.array([apart]))[0][2] == 2


def test_composition_equals_cascade():
    r = random.Random(1)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.weighing()]
    whole = toxicity.grammar()
    for _ in range(300):
        symbols = [r.randrange(9) for _ in range(r.randint(0, 15))]
        total, now = 0.0, symbols
        for t in parts:
            state, out = 0, []
            for s in now:
                o, w, state = t.step(state, s)
                out.append(o)
                total += w
            now = out
        assert abs(whole.weight(symbols) - total) < 1e-9


def test_toxicity_query_against_brute_force(spark):
    """The query's rows: clauses by regular expressions, each through the four transducers in turn."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    lexicon = {k.encode(): v for k, v in toxicity.learned(docs, spark.read.parquet(f"{SF2}/labels.parquet")).items()}
    verbs = {x.encode() for x in toxicity.THREATS}
    words = {w.encode(): s for s, ws in ((toxicity.G, toxicity.TARGETS), (toxicity.N, toxicity.NEGATIONS), (toxicity.R, toxicity.REPORTS)) for w in ws}
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.weighing()]
    cut = {b"don", b"isn", b"aren", b"wasn", b"didn", b"doesn", b"won", b"can"}
    want = {}
    for r in docs.select("doc_id", F.lower("text").alias("text")).collect():
        place, found = 0, []
        for clause in re.split(rb"[.!?;\n]", (r.text or "").encode()):
            symbols, first = [], None
            for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", clause):
                w = m.group()
                s = max([lexicon.get(w[:k], 0) for k in range(1, len(w) + 1)] + [toxicity.V * (w in verbs)])
                first = place if s and first is None else first
                symbols.append(s or words.get(w, toxicity.N if w in cut and clause[m.end() : m.end() + 2] == b"'t" else toxicity.O))
                place += 1
            score = 0.0
            for t in parts if first is not None else []:
                state, out = 0, []
                for s in symbols:
                    o, w, state = t.step(state, s)
                    out.append(o)
                    score += w
                symbols = out
            if score > 0:
                found.append((first, score))
        if any(sum(g for q, g in found[: i + 1] if q > p - toxicity.REACH) >= toxicity.THRESHOLD - 1e-9 for i, (p, _) in enumerate(found)):
            want[r.doc_id] = (round(sum(g for _, g in found), 4), len(found))
    assert {r.doc_id: (r.score, r.clauses) for r in registry.op8_toxicity(spark, SF2).collect()} == want and len(want) > 20


def test_toxicity_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learned(docs, labels.where("doc_id % 2 = 0"))
    flagged = {r.doc_id for r in toxicity.toxic_documents(docs, lexicon).select("doc_id").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    hit = sum(r.doc_id in flagged for r in held if r.toxic) / sum(r.toxic for r in held)
    wrong = sum(r.doc_id in flagged for r in held if not r.toxic) / sum(not r.toxic for r in held)
    assert hit >= 0.85 and wrong <= 0.01


# 9

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip(ids):
    code = token_output.encode(np.array(ids, np.uint32))
    assert token_output.decode(code).tolist() == ids and token_output.size(code) == len(ids)
    for i in random.Random(len(ids)).sample(range(len(ids)), min(20, len(ids))):
        assert token_output.get(code, i) == ids[i]
    with pytest.raises(IndexError):
        token_output.get(code, len(ids))


def test_output_decodes_to_the_texts(spark):
    own, text = tokenizer(), texts(spark)
    got = registry.op9_token_output(spark, SF)
    rows = got.collect()
    assert len(rows) == len(text) and all(own.decode(token_output.decode(r.code)) == text[r.doc_id] for r in rows)
    at = got.withColumn("i", F.lit(3).cast("long")).withColumn("t", token_output.token_at("code", "i")).collect()
    assert all(r.t == (token_output.decode(r.code)[3] if r.n_tokens > 3 else None) for r in at)


# 10

def test_near_pairs_all_meet(spark):
    """Every pair of signatures within the radius ends in one group, and groups are those of brute force."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    which, sig = near_dedup.signatures(pa.array([r.text.lower() for r in rows]))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(which)):
        for j in np.flatnonzero((sig[i + 1 :] != sig[i]).sum(1) <= near_dedup.RADIUS) + i + 1:
            a, b = find(which[i]), find(which[j])
            parent[max(a, b)] = min(a, b)
    want = {(rows[i].doc_id, rows[find(i)].doc_id) for i in range(len(rows)) if find(i) != i}
    assert {tuple(r) for r in near_dedup.near_duplicates(docs).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, near_dedup.SYMBOLS - 1), max_size=near_dedup.RADIUS, unique=True), st.integers(0, 99))
def test_pigeonhole(places, seed):
    a = np.random.default_rng(seed).integers(0, 256, (1, near_dedup.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    b[0, places] += 1
    assert (near_dedup.keys(a) == near_dedup.keys(b)).any()


def test_recall_of_similar_texts():
    r = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    found = 0
    for _ in range(100):
        a = [r.choice(words) for _ in range(300)]
        b = [w if r.random() > 0.02 else r.choice(words) for w in a]
        _, sig = near_dedup.signatures(pa.array([" ".join(a), " ".join(b)]))
        found += (sig[0] != sig[1]).sum() <= near_dedup.RADIUS
    assert found >= 95


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)]
    for local in (0, 1000):
        got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long"), local).collect()
        assert len(got) == 44 and {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joined_edges_are_components():
    r = random.Random(4)
    for _ in range(30):
        pairs = [(r.randrange(40), r.randrange(40)) for _ in range(r.randrange(45))]
        of = {x: {x} for p in pairs for x in p}
        for a, b in pairs:
            both = of[a] | of[b]
            for x in both:
                of[x] = both
        got = near_dedup._joined(pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())}))
        assert dict(zip(got.column("node").to_pylist(), got.column("root").to_pylist())) == {x: min(s) for x, s in of.items()}


def test_unrelated_short_texts_have_own_signatures():
    r = random.Random(6)
    words = ["w%d" % i for i in range(4000)]
    three = list({" ".join(r.sample(words, 3)) for _ in range(5000)})
    for rows in (three, words):
        _, sig = near_dedup.signatures(pa.array(rows))
        assert len({s.tobytes() for s in sig}) == len(rows)
        near = [(sig[i + 1 :] != sig[i]).sum(1).min() for i in range(0, len(sig) - 1, 50)]
        assert min(near) > near_dedup.RADIUS


def test_near_duplicates_share_their_shingles(spark):
    """By brute force over the sets of shingles: no text is dropped for one it has little in common with."""
    import re

    text = texts(spark, "/root/testdata/sf0.1")

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower()) or re.findall(r"\S+", t)
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}

    got = registry.op10_near_dedup(spark, "/root/testdata/sf0.1").collect()
    alike = [len(a & b) / len(a | b) for a, b in ((grams(text[r.doc_id]), grams(text[r.duplicate_of])) for r in got)]
    assert len(got) > 1000 and min(alike) > 0.3


def test_members_of_a_hot_key_are_compared_in_tiles(spark):
    """20,000 signatures share all symbols of a key; near ones are in pairs, far from the key's least
    member. Tiles link just the pairs, whatever the size of a tile."""
    rng = np.random.default_rng(12)
    n = 10_000
    sig = rng.integers(0, 256, (n, near_dedup.SYMBOLS), dtype=np.uint8)
    sig[:, :6] = 7
    twin = sig.copy()
    twin[:, 20:30] += 1
    rows = [(int(2 * i + k), s.tobytes()) for i in range(n) for k, s in ((0, sig[i]), (1, twin[i]))]
    folded = spark.createDataFrame(rows, "node long, sig binary")
    got = near_dedup._roots(folded, 1500).collect()
    assert {r.node: r.root for r in got} == {2 * i + k: 2 * i for i in range(n) for k in (0, 1)}


def test_dense_hot_key(spark):
    """All members of a key within the radius of each other are one group, without a tile."""
    base = np.random.default_rng(2).integers(0, 256, near_dedup.SYMBOLS, dtype=np.uint8)
    rows = []
    for i in range(20_000):
        s = base.copy()
        s[40 + i % 9] = i // 9 % 256
        s[50 + i % 7] = i % 251
        rows.append((i, s.tobytes()))
    got = near_dedup._roots(spark.createDataFrame(rows, "node long, sig binary")).collect()
    assert len(got) == 20_000 and {r.root for r in got} == {0}


def test_keys_of_rows_survive_another_reading(spark, tmp_path):
    """Twice the same rows, whatever the splits and the leaf parallelism between writing and reading."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    where = str(tmp_path / "in 1%/docs")
    docs.repartition(8).write.parquet(where)

    def results():
        many = spark.read.parquet(where)
        return [near_dedup.drop_near_duplicates(many), mixing.keep_mixed(many), with_uid(many).select(UID, "doc_id")]

    want = [sorted(map(tuple, r.collect()), key=repr) for r in results()]
    assert len({u for u, _ in want[2]}) == docs.count()
    built = results()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
        assert [sorted(map(tuple, r.collect()), key=repr) for r in built] == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_file_bits_tell_files_apart():
    files = [f"file:///data/part-{i:05d}.parquet" for i in range(5000)]
    bits, seed = file_bits(files)
    assert len({path_hash(f, seed) >> (64 - bits) for f in files}) == 5000 and bits < 28
    assert path_hash("file:/a/b", 1) == path_hash("file:///a/b", 1)


def test_word_windows_match_slices():
    r = random.Random(2)
    rows = ["  ".join(r.choice(["aa", "b", "ccc"]) for _ in range(r.randint(0, 30))) for _ in range(40)]
    words = Words(pa.array(rows))
    flat = [w for t in rows for w in t.split()]
    assert len(flat) == len(words)
    h = windows(words.hashes(), 4)
    slices = [tuple(flat[i : i + 4]) for i in range(len(flat) - 3)]
    assert len(set(zip(slices, h.tolist()))) == len(set(slices)) == len(set(h.tolist()))


# pipeline

def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    bench, labels = spark.read.parquet(f"{SF2}/benchmark.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    ids = lambda df, c="doc_id": {r[c] for r in df.select(c).collect()}
    now = docs

    def through(k):
        where = scratch(spark, "stage")
        corpus_pipeline.STAGES[k][1](spark, now, SF2).write.parquet(where)
        return spark.read.parquet(where)

    toxic = ids(toxicity.toxic_documents(docs, toxicity.learned(docs, labels)))
    now = through(0)
    assert toxic and ids(now) == left - toxic
    spare = ids(near_dedup.near_duplicates(now))
    before, now = ids(now), through(1)
    assert spare and ids(now) == before - spare
    leaks = ids(decontaminate.contaminated(now, bench))
    before, now = ids(now), through(2)
    assert leaks and ids(now) == before - leaks
    chosen = ids(mixing.mix_sources(now))
    now = through(3)
    assert ids(now) == chosen and now.columns == docs.columns
    text = {r.doc_id: r.text for r in now.collect()}
    out = through(4).collect()
    own = tokenizer()
    assert {r.doc_id for r in out} == chosen and all(own.decode(token_output.decode(r.code)) == text[r.doc_id] for r in out)
