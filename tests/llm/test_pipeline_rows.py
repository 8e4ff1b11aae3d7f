"""Stages of the pipeline on nulls, empties, repeats, ties, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadline.plans.staging import stage

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, place long, n_dropped long, predicted long"


def odd_rows():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long = words(8000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, words(60)), (None, None), (4, long), (5, "a\n\nb"), (5, "a\n\nb"), (6, words(50))]
    return [(i, t, None if n % 3 else "en", "s", len(t or ""), 0.5, 7, None, 4, 1) for n, (i, t) in enumerate(texts)]


def test_odd_rows_pass_all_stages(spark, sf_dir):
    rows = odd_rows()
    docs = stage(spark.createDataFrame(rows, SHAPE))
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"odd-{name}")
        assert docs.columns == SHAPE.replace(" long", "").replace(" string", "").replace(" double", "").split(", "), name
        got = sorted(docs.collect(), key=str)
        want = sorted(spark.createDataFrame(rows, SHAPE).collect(), key=str)
        if name in ("line_dedup", "ngram_join", "decontamination"):  # a null text is written back as empty
            got = sorted((tuple(r[:1]) + ((r[1] or ""),) + tuple(r[2:]) for r in got), key=str)
            want = sorted((tuple(r[:1]) + ((r[1] or ""),) + tuple(r[2:]) for r in want), key=str)
        assert list(map(tuple, got)) == list(map(tuple, want)), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in rows}
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert sum(r["doc_tokens"] == 1 for r in pieces) == 4  # the end token of texts without words


def test_empty_tables_pass_all_stages(spark, sf_dir):
    empty = stage(spark.createDataFrame([], SHAPE))
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("copies", [5])
def test_copies_leave_one_document(spark, sf_dir, copies):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(100 + i, text, "en", "s", len(text), 0.0, 0, 0, 0, 0) for i in range(copies)]
    got = dict(corpus_pipeline.STAGES)["ngram_join"](spark, spark.createDataFrame(rows, SHAPE).withColumn("component_id", F.lit(3).cast("long")), sf_dir)
    assert [r["doc_id"] for r in got.collect()] == [100]
