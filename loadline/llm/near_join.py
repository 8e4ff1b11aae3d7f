"""Set-similarity join on word n-grams: rare-first prefix filter, without pairs inside groups.

1. *Frequencies.* Document frequencies of all shingles in a fixed table of ``BUCKETS`` hashed
   counters, reduced to one byte of log frequency each (4 MB, broadcast).  Any order of shingles gives
   right results; rare-first keeps the lists short.
2. *Profiles.* Per document: set size, 128-bit identity of the set, cell counts of the set, and its prefix, the
   n - ceil(t n) + 1 rarest shingles.  Documents of equal sets become one class and go on as its representative.
3. *Stars.* In every prefix list the member whose rarest shingle is most common leads (the
   original among edited copies) and is paired with the others of fitting length.
   The leader is a partial aggregate joined back, so a list may hold a third of all documents.
4. *Suffix filter.* Cell counts bound the symmetric difference of two sets from below; pairs beyond what
   the threshold allows are gone.  The rest is verified once, on the exact sets, and linked.
5. *Rest.* Links join documents into components.  Only members of different components in one list can
   still add anything; long lists get another star with new leaders, then all cross-component pairs that pass the
   length and positional filters in the join, and the suffix filter, are verified.  So every link between components is found, but no pairs within a group are listed.

Shingles are compared by 64-bit hashes.  Defined cases: null or empty text (or only white
space) has an empty set and links with nothing; fewer than ``k`` words count as one shingle; rows with one
doc_id are one node; a null doc_id gets a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import WordHashes, byte_rows, components, lean_batches, more_components, only_cache, shingles, words_of
from loadline.plans.staging import stage

BUCKET_BITS = 22
BLOCK_BITS = 16
CELLS = 64
#: Stars before the cross-component pairs; from the second on for lists of more than LONG_LIST components.
STARS, LONG_LIST = 2, 30
#: Estimated frequency from which a list is not funnelled through one task to see if it is single.
WIDE_LIST = 1 << 14

_hashes = WordHashes()


def text_set(text: bytes | None, k: int) -> np.ndarray:
    return shingles(_hashes(words_of(text)), k)


def log_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """One byte (4 log2(1 + df)) per hashed bucket, from all documents."""
    blocks = 1 << (BUCKET_BITS - BLOCK_BITS)

    def count(batches):
        only_cache(_hashes.known)
        total = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in batches:
            held, size = [], 0
            for text in byte_rows(batch.column("text")):
                held.append(text_set(text, k))
                size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
            if size:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(blocks, dtype=np.int32)), pa.array([x.tobytes() for x in total.reshape(blocks, -1)], pa.binary())],
                ["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for x in rows["counts"]:
            total += np.frombuffer(x, np.uint32)
        levels = np.minimum(4 * np.log2(1 + total.astype(float)), 255).astype(np.uint8)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "levels": [levels.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, levels binary")
    out = np.zeros((blocks, 1 << BLOCK_BITS), np.uint8)
    for block, levels in parts.collect():  # a fixed number of blocks, 4 MB in all
        out[block] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def profiles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, same, cells, prefix): prefix tokens carry their level in the top byte, ascending."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(log_frequencies(docs, k))

    def run(batches):
        only_cache(_hashes.known)
        rank = levels.value
        for batch in batches:
            n, same, cells, prefix = [], [], [], []
            for text in byte_rows(batch.column("text")):
                own = text_set(text, k)
                n.append(len(own))
                if not len(own):
                    same.append(None), cells.append(None), prefix.append(None)
                    continue
                same.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                cells.append(np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
                token = (rank[own >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(55)) | (own >> np.uint64(9))
                size = len(own) - -(-num * len(own) // den) + 1
                prefix.append(np.sort(np.partition(token, size - 1)[:size]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(same, pa.binary()), pa.array(cells, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "same", "cells", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return stage(rows.mapInArrow(run, "doc_id long, n int, same binary, cells binary, prefix array<long>"), "profiles")


def needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Least overlap of linked sets: den * o >= num * (a + b - o)."""
    return F.ceil((num * (a + b)) / (num + den))


def suffix_filtered(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose cell counts leave room for the threshold."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
    wide = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(batches):
        for batch in batches:
            ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("ca", "cb"))
            na, nb = (np.asarray(batch.column(c)).astype(np.int64) for c in ("na", "nb"))
            least = -(-num * (na + nb) // (num + den))
            keep = np.abs(ca - cb).sum(1) <= na + nb - 2 * least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return wide.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose exact sets reach the threshold."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def sets(batches):
        only_cache(_hashes.known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([text_set(x, k).tobytes() for x in byte_rows(batch.column("text"))], pa.binary())], ["id", "items"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(need, F.col("doc_id") == F.col("node"), "left_semi")
    held = stage(rows.mapInArrow(sets, "id long, items binary"), "sets")
    wide = (pairs.join(held.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
            .join(held.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a").select("a", "b", "ia", "ib"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia"), batch.column("ib")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row; links have den*inter >= num*union."""
    lean_batches(docs.sparkSession)
    prof = profiles(docs, k, num, den)
    classes = stage(prof.filter("n > 0 AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(prof.join(classes.withColumnRenamed("same", "_same"), (F.col("same") == F.col("_same")) & (F.col("doc_id") == F.col("rep")), "left_semi"), "reps")
    tokens = reps.select(F.col("doc_id").alias("rep"), "n", F.element_at("prefix", 1).alias("first"), F.posexplode("prefix").alias("pos", "token"))
    wide = F.shiftrightunsigned("token", 55) >= int(4 * np.log2(1 + WIDE_LIST))
    counted = tokens.filter(~wide).withColumn("_n", F.expr("count(1) OVER (PARTITION BY token)")).filter("_n > 1").drop("_n")
    lists = stage(counted.unionByName(tokens.filter(wide)), "lists")
    fits = (F.greatest("n", "n2") * num <= F.least("n", "n2") * den)

    def stars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        lead = rows.groupBy(F.col("token").alias("t2")).agg(F.max(F.struct("first", (-F.col("rep")).alias("m"), "n", "pos")).alias("l"))
        lead = lead.select("t2", (-F.col("l.m")).alias("rep2"), F.col("l.n").alias("n2"), F.col("l.pos").alias("pos2"))
        met = rows.join(lead, (F.col("token") == F.col("t2")) & (F.col("rep") != F.col("rep2")) & fits)
        return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), lead

    def link(pairs: DataFrame) -> DataFrame:
        return stage(verified(stage(suffix_filtered(pairs, reps, num, den), "pairs"), docs, k, num, den), "links")

    def open_lists(rows: DataFrame, comp: DataFrame) -> DataFrame:
        """Rows of lists that still meet several components, with the component and their number."""
        named = rows.drop("comp", "comps").join(comp.withColumnRenamed("component", "c"), F.col("rep") == F.col("node"), "left")
        named = named.withColumn("comp", F.coalesce("c", "rep")).drop("node", "c")
        spread = named.groupBy(F.col("token").alias("t2")).agg(F.approx_count_distinct("comp", 0.1).alias("comps"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        spread = spread.filter("lo <> hi").select("t2", "comps")
        return stage(named.join(spread, F.col("token") == F.col("t2")).drop("t2"), "open-lists")

    pairs, lead = stars(lists)
    comp = stage(components(link(pairs)), "components")
    rest = lists
    for turn in range(STARS):
        rest = open_lists(rest, comp)
        # a leader has met its whole list
        rest = stage(rest.join(lead.select("t2", "rep2"), (F.col("token") == F.col("t2")) & (F.col("rep") == F.col("rep2")), "left_anti"), "open-lists")
        if turn == STARS - 1 or (long := rest.filter(F.col("comps") > LONG_LIST)).isEmpty():
            break
        pairs, lead = stars(long)
        comp = more_components(comp, link(pairs))
    left = rest.select("token", "rep", "n", "pos", "comp")
    right = left.select(F.col("token").alias("t2"), F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))
    # at its first common token a pair can still share no more than what follows; at later ones it need not pass
    room = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1) >= needed(F.col("n"), F.col("n2"), num, den)
    # the smaller set of a pair shares at least 2 num / (num + den) of its own size, so fewer of its rarest tokens have to be looked up
    few = F.col("pos") <= F.col("n") - F.ceil(2 * num * F.col("n") / (num + den))
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("rep") < F.col("rep2")))
    met = left.filter(few).join(right, (F.col("token") == F.col("t2")) & smaller & (F.col("comp") != F.col("comp2")) & fits & room)
    more = link(met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct())
    comp = more_components(comp, more)
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("same", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    named = named.withColumnRenamed("same", "_same")
    return prof.join(named, F.col("same") == F.col("_same"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents without near duplicates: of each component the smallest doc_id stays, once."""
    gone = similar(docs, k, num, den).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
