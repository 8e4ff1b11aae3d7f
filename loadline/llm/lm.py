"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and word pairs are quantised, q = 1 + floor(log_b count), and an n-gram is put
into the filter once for each level 1..q; a lookup probes level after level until one is missing.
Error is one-sided: a count is never read too low.

The filter is made in shards by the hash of an n-gram's last word, each sized for what it
holds.  Scores are Dirichlet-smoothed, P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu), so their logarithm is a
sum of terms that each need one shard only:

    log mu + log P(w) + log(1 + c(vw) / (mu P(w)))  by w,     - log(c(v) + mu)  by v.

Shards are therefore broadcast in groups of at most ``broadcast_mb``; every group takes one pass over
the texts and the sums are added.  Filter and passes grow with the corpus, a task's memory does
not.  The exact word counts of a group travel with it, for the base score.

Tokens are words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end token.  Words are
told apart by 64-bit hashes.

Defined cases: null text is empty and has the end token only; rows with one doc_id are rows of
their own; a null doc_id is scored but not learnt from; without training rows all counts are zero; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import CACHE_WORDS, WordHashes, byte_rows, lean_batches, mix, only_cache, words_of
from loadline.plans.staging import stage

END = xxhash.xxh3_64_intdigest(b" end")
BEGIN = xxhash.xxh3_64_intdigest(b" begin")
WORD_BASE, PAIR_BASE = 1.1, 1.5
BITS, PROBES = 10, 4
CHUNK = 200_000
#: Training text behind a shard, and shards fetched at a time.
SHARD_BYTES, FETCHED = 4 << 20, 32

_hashes = WordHashes()


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) ^ (word << np.uint64(1)) ^ np.uint64(0x51ED270B))


def level_keys(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))


def positions(keys: np.ndarray, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of a probe in a table of ``bits`` bits."""
    low = np.uint64(0xFFFFFFFF)
    return ((((keys & low) + np.uint64(probe) * ((keys >> np.uint64(32)) | np.uint64(1))) & low) * bits) >> np.uint64(32)


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def expected(levels: np.ndarray, base: float) -> np.ndarray:
    """Mean count of a level; 0 for level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.maximum(np.ceil(base ** levels.astype(float) - 1e-9) - 1, low)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def counted(parts: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total counts."""
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], np.concatenate(counts).astype(np.int64)[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(keys) else weights


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (words >> np.uint64(40)) % np.uint64(shards)


def count_ngrams(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, keys, counts): packed partial counts of each task; kind 0 words, 1 pairs."""

    def run(batches):
        only_cache(_hashes.known)
        names = ["shard", "kind", "keys", "counts"]

        def out(kind, owner, keys, counts):
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(shards + 1))
            ks, cs = keys[order], counts[order].astype(np.uint32)
            rows = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([kind] * len(rows), pa.int32()),
                 pa.array([ks[cuts[s]:cuts[s + 1]].tobytes() for s in rows], pa.binary()),
                 pa.array([cs[cuts[s]:cuts[s + 1]].tobytes() for s in rows], pa.binary())], names)

        def flush(held):
            tokens = np.concatenate(held)
            words, n = counted([tokens[tokens != np.uint64(BEGIN)]])
            yield out(0, shard_of(words, shards), words, n)
            before, word = tokens[:-1], tokens[1:]
            real = word != np.uint64(BEGIN)
            word = word[real]
            keys = pair_keys(before[real], word)
            first, at, n = np.unique(keys, return_index=True, return_counts=True)
            yield out(1, shard_of(word[at], shards), first, n)

        held, size = [], 0
        for batch in batches:
            for text in byte_rows(batch.column("text")):
                held += [np.array([BEGIN], np.uint64), _hashes(words_of(text)), np.array([END], np.uint64)]
                size += len(held[-2]) + 2
                if size > 1_200_000:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(run, "shard int, kind int, keys binary, counts binary")


def build_filter(partial: DataFrame) -> DataFrame:
    """(shard, words, counts, distinct, total, bits, cells): a shard's exact word counts and its Bloom filter."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for kind in (0, 1):
            own = rows[rows["kind"] == kind]
            tables.append(counted([np.frombuffer(x, np.uint64) for x in own["keys"]], [np.frombuffer(x, np.uint32) for x in own["counts"]]))
        (words, n), (pairs, m) = tables
        levels = [quantised(n, WORD_BASE), quantised(m, PAIR_BASE)]
        bits = max(64, BITS * int(levels[0].sum() + levels[1].sum()))
        cells = np.zeros(bits, bool)
        for keys, q in zip((words, pairs), levels):
            for level in range(1, (int(q.max()) if len(q) else 0) + 1):
                keys, q = keys[q >= level], q[q >= level]
                at = level_keys(keys, level)
                for probe in range(PROBES):
                    cells[positions(at, probe, np.uint64(bits)).astype(np.int64)] = True
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "words": [words.tobytes()], "counts": [n.astype(np.int64).tobytes()],
                             "distinct": [len(words)], "total": [int(n.sum())], "bits": [bits], "cells": [np.packbits(cells, bitorder="little").tobytes()]})

    return partial.groupBy("shard").applyInPandas(
        build, "shard int, words binary, counts binary, distinct long, total long, bits long, cells binary")


def gathered(filters: DataFrame, shards: list) -> tuple:
    """Some shards as plain arrays: shard, bits, bytes, cells, and their words in order with counts.

    ``shards`` are rows (shard, distinct, cells' bytes); ``FETCHED`` at a time go into arrays of known size.
    """
    ids, bits, sizes = [], [], []
    cells = np.empty(sum(r["cells"] for r in shards), np.uint8)
    words, counts = (np.empty(sum(r["distinct"] for r in shards), kind) for kind in (np.uint64, np.int64))
    at = here = 0
    for lo in range(0, len(shards), FETCHED):
        some = [r["shard"] for r in shards[lo:lo + FETCHED]]
        rows = filters.filter(F.col("shard").isin(some)).select("shard", "words", "counts", "bits", "cells").toArrow()
        for shard, own, n, m, data in zip(*(rows.column(c) for c in rows.column_names)):
            data, own = np.frombuffer(data.as_buffer(), np.uint8), np.frombuffer(own.as_buffer(), np.uint64)
            cells[at:at + len(data)] = data
            words[here:here + len(own)] = own
            counts[here:here + len(own)] = np.frombuffer(n.as_buffer(), np.int64)
            ids.append(shard.as_py()), bits.append(m.as_py()), sizes.append(len(data))
            at, here = at + len(data), here + len(own)
    order = np.argsort(words)
    return np.array(ids, np.int64), np.array(bits, np.uint64), np.array(sizes, np.int64), cells, words[order], counts[order]


class Group:
    """Some shards of the filter in a worker: probes and word lookups."""

    def __init__(self, held: tuple, shards: int) -> None:
        ids, bits, sizes, self.cells, self.words, self.counts = held
        self.shards = shards
        self.bits = np.zeros(shards, np.uint64)
        self.offset = np.zeros(shards, np.uint64)
        self.here = np.zeros(shards, bool)
        self.bits[ids], self.here[ids] = bits, True
        self.offset[ids] = 8 * (np.cumsum(sizes) - sizes)
        self.known: dict[bytes, int] = {}
        self.size = 0
        self.table = np.zeros((3, 1024))  # exact count, quantised count, in this group
        self.hash = np.zeros(1024, np.uint64)

    def probe(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Levels found in a row, from 1, for keys whose shards are here."""
        found = np.zeros(len(keys), np.int64)
        left, level = np.flatnonzero(self.here[owner]), 0
        while len(left):
            level += 1
            k, s = level_keys(keys[left], level), owner[left]
            hit = np.ones(len(left), bool)
            for p in range(PROBES):
                bit = self.offset[s] + positions(k, p, self.bits[s])
                hit &= (self.cells[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    left, k, s = left[hit], k[hit], s[hit]
                    hit = hit[hit]
            found[left] = level
        return found

    def learn(self, words: list[bytes]) -> None:
        if self.size > CACHE_WORDS:
            self.known.clear()
            self.size = 0
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) if w != b" end" else END for w in new], np.uint64)
        owner = shard_of(hashes, self.shards).astype(np.int64)
        exact = np.zeros(len(new))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            exact = np.where(self.words[at] == hashes, self.counts[at], 0)
        need = self.size + len(new)
        while need > len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        span = slice(self.size, need)
        self.hash[span] = hashes
        self.table[0, span] = exact
        self.table[1, span] = expected(self.probe(hashes, owner), WORD_BASE)
        self.table[2, span] = self.here[owner]
        self.known.update(zip(new, range(self.size, need)))
        self.size = need

    def look(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(words)
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def score_pass(docs: DataFrame, group: tuple, shards: int, total: int, distinct: int, starts: int, mu: float, opening: bool) -> DataFrame:
    """A group's part of every row's sums; starts: training texts, the count of the begin mark, which the opening pass adds."""
    held = docs.sparkSession.sparkContext.broadcast(group)

    def run(batches):
        model = Group(held.value, shards)
        only_cache(model.known)
        whole = math.log10(total + distinct + 1)

        def rows(words: list[list[bytes]]):
            lengths = np.array([len(w) for w in words], np.int64)
            at = model.look([w for part in words for w in part])
            starts_at = np.r_[0, np.cumsum(lengths)[:-1]]
            exact, read, here = model.table[:, at]
            hashes = model.hash[at]
            before = np.r_[np.uint64(BEGIN), hashes[:-1]]
            before[starts_at] = BEGIN
            word_log = np.log10(read + 1) - whole
            pairs = expected(model.probe(pair_keys(before, hashes), shard_of(hashes, shards).astype(np.int64)), PAIR_BASE)
            gain = np.log10(1 + pairs / (mu * 10.0 ** word_log))
            context = np.log10(read + mu)
            context[starts_at + lengths - 1] = 0  # the end token is no context
            score = here * (math.log10(mu) + word_log + gain - context)
            first = -math.log10(starts + mu) if opening else 0.0
            return (lengths, np.add.reduceat((exact > 0).astype(np.int64), starts_at),
                    np.add.reduceat(here * (np.log10(exact + 1) - whole), starts_at), np.add.reduceat(score, starts_at) + first)

        for batch in batches:
            words, size, out = [], 0, []
            for text in byte_rows(batch.column("text")):
                words.append([*words_of(text), b" end"])
                size += len(words[-1])
                if size > CHUNK:
                    out.append(rows(words))
                    words, size = [], 0
            if words:
                out.append(rows(words))
            if out:
                n, known, base, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(score)],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, train: DataFrame, mu: float = 1000.0, shards: int | None = None, broadcast_mb: int = 192) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``, learnt from ``train``.

    ``shards`` defaults to one for ``SHARD_BYTES`` of training text, so what one task builds is as large for any corpus.
    """
    lean_batches(docs.sparkSession)
    if shards is None:
        shards = max(64, -(-(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    filters = stage(build_filter(count_ngrams(train, shards)), "lm-filter")
    sizes = filters.select("shard", F.length("cells").alias("cells"), "distinct", "total").collect()  # a row a shard
    total, distinct = sum(r["total"] for r in sizes), sum(r["distinct"] for r in sizes)
    starts = train.count()
    groups: list[list] = [[]]
    room = broadcast_mb << 20
    for r in sorted(sizes, key=lambda r: r["shard"]):
        size = r["cells"] + 16 * r["distinct"]
        if groups[-1] and room < size:
            groups.append([])
            room = broadcast_mb << 20
        groups[-1].append(r)
        room -= size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    if len(groups) > 1:
        rows = stage(rows, "lm-rows")  # the passes add up by row, so a row has one number in all of them
    sums = None
    for i, own in enumerate(groups):
        group = gathered(filters, own)  # within broadcast_mb
        part = score_pass(rows, group, shards, total, distinct, starts, mu, i == 0)
        del group
        if len(groups) > 1:
            part = stage(part, "lm-pass")
        sums = part if sums is None else sums.union(part)
    if len(groups) > 1:
        sums = sums.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                       F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
