"""What every operator and stage makes of nulls, empty and long texts, repeated rows, empty tables and
columns whose names clash with its own."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, line_dedup, mixing, near_dedup, quality, substring_dedup, token_counts, token_output, toxicity, weak_labels
from graphloom.storage import scratch

WORDS = "amber basin cedar delta ember fable grove harbor island jungle kettle lantern meadow nectar orchard pepper quartz river saddle timber".split()


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, keep int, n_tokens int, bucket string, __gl_uid string, `__GL_plain` int, __gl_lower string, `a.b c` long"


@pytest.fixture(scope="module")
def rows():
    same = prose(1)
    rows = [
        (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, None, None, None), (None, None, None, None, None), (None, prose(2), "en", "b", 3),
        (3, "", "en", "a", 0), (4, None, "en", "a", None), (5, "x", "en", "b", 1), (6, "   \n \n\n", "en", "b", 1), (7, prose(3, 60_000), "de", "c", 9),
        (8, prose(4) + "\n" + prose(5), "en", "c", 9), (9, "word " * 3000, "en", "a", 1), (10, "!!! ??? ...", "fr", "b", 2), (11, "töricht naïve 東京 " * 40, "de", "c", 2),
    ]
    return [(*r, 0.5, "n", 1, 2, "b", "u", 3, "l", 4) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (8, None, None), (7, 1, 0), (9, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(4)), (None, prose(4)), (2, None), (3, ""), (4, "amber"), (5, "one two three four five")], "item_id long, text string")


def test_decontaminate(docs, none, bench):
    got = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()), key=repr)
    assert {(d, i) for d, i, _, _ in got} == {(8, 1), (8, None)}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_token_counts(spark, docs, none):
    totals = token_counts.token_counts(docs, scratch(spark, "l"))
    assert totals.agg(F.sum("docs")).first()[0] == docs.count()
    assert totals.where("source is null and lang is null").first().docs == 2
    assert token_counts.token_counts(none, scratch(spark, "l")).count() == 0


def test_substring(docs, none):
    got = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.ref_doc_id, r.words) for r in got} == {(1, 1, 120), (2, 1, 120)}
    assert substring_dedup.repeated_passages(none).count() == 0


def test_line_dedup(spark, docs, none):
    got = line_dedup.line_dedup(docs)
    assert got.count() == docs.count() and got.where("removed > 0").count() == 0 and got.where("text is null").count() == 2
    assert line_dedup.line_dedup(none).count() == 0
    three = spark.createDataFrame([(2, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (None, "z\na \nb\nc"), (1, "q\na\nb\nc"), (3, "\n\n\n\n")], "doc_id long, text string")
    assert sorted([tuple(r) for r in line_dedup.line_dedup(three).collect()], key=repr) == sorted([(1, "q\na\nb\nc", 0), (2, "d", 3), (2, "", 4), (None, "z", 3), (3, "\n\n\n\n", 0)], key=repr)


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, weights={"a": 1, None: 1}, budget=10**9).collect()
    assert {r.source for r in got} == {"a", None} and all(r.n_tokens > 0 for r in got)
    assert sum(r.source is None for r in got) == 1 and sum(r.doc_id == 1 for r in got) == 2
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(docs, budget=0).count() == 0


def test_toxicity(docs, none, labels):
    lexicon = toxicity.learned(docs, labels)
    assert toxicity.toxic_documents(docs, lexicon).count() == 0 and toxicity.toxic_documents(none, lexicon).count() == 0
    assert toxicity.learned(none, labels) == toxicity.learned(docs, labels.limit(0)) == toxicity.builtin()
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_token_output(docs, none):
    got = token_output.token_output(docs).collect()
    assert len(got) == docs.count() and all((r.n_tokens == 0) == (token_output.size(r.code) == 0) for r in got)
    assert sum(r.n_tokens == 0 for r in got) == 3 and token_output.token_output(none).count() == 0


def test_near_dedup(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.duplicate_of) for r in got) == [(1, 1), (2, 1)]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


def test_near_dedup_null_id_last(spark):
    text = prose(9)
    two = spark.createDataFrame([(None, text), (5, text)], "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.near_duplicates(two).collect()] == [(None, 5)]


def test_quality(docs, none, labels):
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == docs.count() and all(r.probability == 0 for r in got if r.doc_id in (3, 4, 6))
    assert quality.quality_rules(none, labels).count() == 0
    assert {r.probability for r in quality.quality_rules(docs, labels.limit(0)).collect()} == {0.0, 0.5}


def test_weak_labels(docs, none):
    got = weak_labels.quality_classifier(docs).collect()
    assert len(got) == docs.count() and all(not r.keep for r in got if r.doc_id in (3, 4, 6))
    assert weak_labels.quality_classifier(none).count() == 0


def test_stages(spark, docs, none, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, none):
        now = given
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            where = str(tmp_path / f"{given is docs}-{k}")
            stage(spark, now, str(tmp_path)).write.parquet(where)
            after = spark.read.parquet(where)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns, name
            now = after
        assert "code" in now.columns and (given is docs or now.count() == 0)
