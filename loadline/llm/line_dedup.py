"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State of a corpus, all of it written tables:

* ``pairs``   (key, doc_id): which document holds which line key, once;
* ``refs``    (key, n_docs, max_doc): exact reference counts;
* ``filters`` (shard, cells): one cuckoo filter per shard with the keys that occur in at
  least ``min_docs`` documents.

``insert`` and ``delete`` change the tables by what the given documents hold and move
only keys that cross ``min_docs`` into or out of the filters (cuckoo filters can forget a
key).  ``dedup`` probes the filters; only lines that pass are looked up in ``refs``.

A line's key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z lower-cased,
kept as a 128-bit digest.  Keys under ``min_chars`` code points are ignored.

Defined cases: null or empty text is one empty line and stays; rows with one doc_id count as
one document; a row with a null doc_id neither counts nor loses lines; an empty table gives
an empty result; other columns pass through, result columns replace columns of their name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import LOWER, SPACE, byte_rows, lean_batches, with_fields
from loadline.plans.staging import stage

SLOTS = 4
KICKS = 500


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a lower-cased line, None if its key is too short to count."""
    line = line.strip(SPACE)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def line_pairs(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (key, doc_id)."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text"))):
                if doc is None or not text:
                    continue
                found = {line_key(x, min_chars) for x in text.translate(LOWER).split(b"\n")}
                found.discard(None)
                keys.extend(found)
                ids.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key binary, doc_id long").distinct()


class Cuckoo:
    """Cuckoo filter over 16-byte keys: 16-bit fingerprints, four to a bucket."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells  # (buckets, SLOTS) uint16, 0 is empty; buckets is a power of two

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        mask = np.uint64(len(self.cells) - 1)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (words[:, 1] >> np.uint64(16)) & mask
        return prints, first, first ^ self.spread(prints)

    def spread(self, prints: np.ndarray) -> np.ndarray:
        """What leads from one bucket of a fingerprint to the other."""
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.cells) - 1)

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, first, second = self.places(keys)
        at = prints[:, None]
        return (self.cells[first] == at).any(1) | (self.cells[second] == at).any(1)

    def insert(self, keys: list[bytes]) -> bool:
        """False if the filter is full; it must then be built anew with more buckets."""
        if not keys:
            return True
        rng = np.random.default_rng(len(keys))
        for p, i, j in zip(*self.places(keys)):
            p, spot = np.uint16(p), None
            for b in (i, j):
                free = np.flatnonzero(self.cells[b] == 0)
                if len(free):
                    spot = (b, free[0])
                    break
            b = j
            for _ in range(KICKS):
                if spot:
                    break
                slot = int(rng.integers(SLOTS))
                p, self.cells[b, slot] = self.cells[b, slot], p
                b = b ^ self.spread(np.array([p]))[0]
                free = np.flatnonzero(self.cells[b] == 0)
                spot = (b, free[0]) if len(free) else None
            if not spot:
                return False
            self.cells[spot] = p
        return True

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        for p, i, j in zip(*self.places(keys)):
            for b in (i, j):
                held = np.flatnonzero(self.cells[b] == p)
                if len(held):
                    self.cells[b, held[0]] = 0
                    break


@dataclass
class LineState:
    pairs: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    def shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")


def empty_state(spark, shards: int = 64, min_docs: int = 3, min_chars: int = 20) -> LineState:
    """``shards``: choose so that a shard's share of the repeated keys fits a task (2.4 bytes a key)."""
    return LineState(spark.createDataFrame([], "key binary, doc_id long"),
                     spark.createDataFrame([], "key binary, n_docs long, max_doc long"),
                     spark.createDataFrame([], "shard int, cells binary"), shards, min_docs, min_chars)


def _counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _moved(state: LineState, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters after the keys that crossed ``min_docs`` have moved in or out."""
    held = F.coalesce("n_docs", F.lit(0)) >= state.min_docs
    was = before.select("key", held.alias("was"))
    now = after.select("key", held.alias("now"))
    crossed = was.join(now, "key", "full").select(
        "key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
    crossed = crossed.filter("was <> now").select(state.shard(), "key", "now")
    kept = after.filter(held).select(state.shard(), "key")

    def change(filters: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        shard = int((filters if len(filters) else moves)["shard"].iloc[0])
        add, drop = list(moves["key"][moves["now"]]), list(moves["key"][~moves["now"]])
        old = Cuckoo.load(filters["cells"].iloc[0]) if len(filters) else Cuckoo.sized(len(add))
        old.delete(drop)
        cells = old.dump() if old.insert(add) else None  # None: too full, to be built anew
        return pd.DataFrame({"shard": [shard], "cells": [cells]})

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        size = len(keys)
        while not (fresh := Cuckoo.sized(size)).insert(list(keys["key"])):
            size = size * 2 + 1
        return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "cells": [fresh.dump()]})

    changed = stage(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
                    .applyInPandas(change, "shard int, cells binary"), "filters")
    full = changed.filter("cells IS NULL").select("shard")
    built = kept.join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInPandas(build, "shard int, cells binary")
    return stage(changed.filter("cells IS NOT NULL").union(built), "filters")


def insert(state: LineState, docs: DataFrame) -> LineState:
    """State with the documents added; what a known document already holds is not counted twice."""
    fresh = stage(line_pairs(docs, state.min_chars), "line-pairs")
    if not state.pairs.isEmpty():
        fresh = stage(fresh.join(state.pairs, ["key", "doc_id"], "left_anti"), "line-pairs")
        pairs = stage(state.pairs.unionByName(fresh), "line-pairs")
    else:
        pairs = fresh
    both = state.refs.unionByName(_counts(fresh))
    refs = stage(both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
                 if not state.refs.isEmpty() else _counts(fresh), "line-refs")
    held = F.col("n_docs") >= state.min_docs
    filters = _moved(state, state.refs.filter(held), refs.filter(held))
    return LineState(pairs, refs, filters, state.shards, state.min_docs, state.min_chars)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """State as if the documents (column doc_id) had never been inserted."""
    gone = doc_ids.select("doc_id").distinct()
    pairs = stage(state.pairs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-pairs")
    touched = stage(state.pairs.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-touched")
    again = _counts(pairs.join(touched, "key", "left_semi"))
    refs = stage(state.refs.join(touched, "key", "left_anti").unionByName(again), "line-refs")
    held = F.col("n_docs") >= state.min_docs
    filters = _moved(state, state.refs.filter(held), refs.filter(held))
    return LineState(pairs, refs, filters, state.shards, state.min_docs, state.min_chars)


def droppable(state: LineState, pairs: DataFrame, task_rows: int = 500_000) -> DataFrame:
    """(doc_id, key) to drop: filter probe first, exact counts for what passes.

    A shard's pairs are dealt over so many salts that a task holds about ``task_rows`` of
    the fullest shard, however often one line occurs.
    """
    pairs = pairs.select(state.shard(), "key", "doc_id")
    fullest = pairs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = 1 + fullest // task_rows
    left = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    right = state.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))

    def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters):
            return rows.iloc[:0][["key", "doc_id"]]
        return rows[Cuckoo.load(filters["cells"].iloc[0]).has(list(rows["key"]))][["key", "doc_id"]]

    maybe = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(probe, "key binary, doc_id long")
    exact = state.refs.filter(F.col("n_docs") >= state.min_docs)
    return maybe.join(exact, "key").filter("doc_id < max_doc").select("doc_id", "key")


def dedup(docs: DataFrame, state: LineState) -> DataFrame:
    """Documents without the lines that a document of larger id also holds.

    ``docs`` are documents of the state.  Text is what stays, joined by a line feed;
    n_lines counts the lines before, n_dropped those gone.
    """
    drops = droppable(state, state.pairs).groupBy("doc_id").agg(F.collect_set("key").alias("_drop"))
    drops = drops.withColumnRenamed("doc_id", "_doc")
    docs = docs.drop("n_lines", "n_dropped")
    joined = docs.join(drops, F.col("doc_id").cast("long") == drops._doc, "left").drop("_doc")
    shape = with_fields(docs, text="string", n_lines="long", n_dropped="long")
    names, min_chars = shape.names, state.min_chars

    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(byte_rows(batch.column("text")), batch.column("_drop").to_pylist()):
                parts = (text or b"").split(b"\n")
                kept = parts
                if drop:
                    gone = set(drop)
                    kept = [x for x in parts if line_key(x.translate(LOWER), min_chars) not in gone]
                texts.append(b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()),
                   "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return joined.mapInArrow(run, shape)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int = 64) -> DataFrame:
    """Build the state of ``docs`` and dedup them."""
    lean_batches(docs.sparkSession)
    state = insert(empty_state(docs.sparkSession, shards, min_docs, min_chars), docs)
    return dedup(docs, state)
