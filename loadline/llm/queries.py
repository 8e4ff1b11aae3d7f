"""Thin queries over the operators, with production parameters and whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadline.llm import (
    chat, decontamination, hard_negatives, html_extract, line_dedup, lm, near_join, packing, pivot_search, runs, sharding, simhash, toxicity,
)
from loadline.llm.common import crc_mod, table


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=3, min_chars=20)
    return kept.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: F.when(pivot_search.finite(x), F.floor(x.cast("double") * 256).cast("double"))).alias("vec"))
    found = pivot_search.search(rows, rows.filter("vec_id % 50 = 0"), k=5)
    return found.withColumn("score", F.col("score").cast("long"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_windows(turns, budget=1024, history=256))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048)
    return piece_digest(pieces)


def piece_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard_by_bytes(docs, shards=40, overhead=16, keep=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored = lm.score_texts(docs, docs.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def near_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.similar(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, seed=42, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def hard_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", label.alias("label"),
        F.transform("embedding", lambda x: F.when(pivot_search.finite(x), F.floor(x.cast("double") * 256).cast("double"))).alias("vec"))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90)


def with_periods(docs: DataFrame) -> DataFrame:
    """In documents with crc32(doc_id) % 10 = 0 the words from a on repeat the first p of them."""
    space = "[\\x20\\x09-\\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", space), lambda w: w != "")
    picked = (docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long"))
              .withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
              .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)).cast("long")))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get(
        "_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return picked.withColumn("text", F.when(F.col("_n") > 0, F.array_join(turned, " ")).otherwise(F.col("text"))).drop("_w", "_n", "_a", "_p")


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, min_length=12, lower=False)  # the contract takes words as they are
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_line_dedup": line_dedup_query,
    "op2_latent_decontamination": decontamination_query,
    "op3_pivot_topk": topk_query,
    "op4_chat_windows": chat_query,
    "op5_curve_packing": packing_query,
    "op6_nnpu_toxicity": toxicity_query,
    "op7_bloom_lm": lm_query,
    "op8_html_wrappers": html_query,
    "op9_ngram_join": near_join_query,
    "op10_differencing_shards": sharding_query,
    "op11_simhash_tiles": simhash_query,
    "op12_gnat_negatives": hard_negative_query,
    "op13_periodic_runs": runs_query,
}
