"""A training corpus in five stages, each on all that the stage before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir).  Its result is written as
Parquet in the shared folder and read again as the next one's ``docs``.  All stages but the last return
the columns of ``documents``; clean documents stay.

Defined cases, for every stage: a null text counts as empty; empty texts are kept and packed as their end token; a null doc_id
is no ground to drop a row; rows that repeat a doc_id are kept or dropped together, but for lines, of which the last row keeps
its own; other columns pass through unchanged (n_chars follows the text); empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.llm import decontamination, line_dedup, near_join, packing, toxicity
from loadline.llm.common import table
from loadline.llm.queries import piece_digest
from loadline.plans.staging import stage


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names out of the way, and the selection that brings them back."""
    moved = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs, back = aside(docs, "score", "predicted")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them; n_chars follows the text."""
    docs, back = aside(docs, "n_lines", "n_dropped")
    kept = line_dedup.dedup_lines(docs, min_docs=3, min_chars=20)
    text = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", text).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays."""
    return near_join.keep_one(docs, k=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return piece_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: A learnt classifier, components and a tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
