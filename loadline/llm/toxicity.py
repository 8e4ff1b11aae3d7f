"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; labelled rows of any kind, their label ignored, are the
unlabelled mixture.  With class prior pi the risk of a scorer f under the logistic loss is

    pi R_p+(f) + max(0, R_u-(f) - pi R_p-(f)),

the second part being the risk on clean text, which can't be negative; where it falls below zero the step
goes the other way (Kiryo et al., 2017).  A linear model in numpy is fitted by Adam.

Features are hashed: each word and its character 3- to 6-grams, word ends marked, present or not in a text.  The
``features`` that are most significantly more frequent in positives than in unlabelled rows enter the model.

Bounded, documented sample: the classifier is fitted on at most ``positives`` toxic and ``unlabelled`` rows, those of
smallest hash of doc_id.  Scores are made for every whole text.

Defined cases: a null or empty text has no feature and gets the score of the bias; a doc_id with several labels is
toxic if any says so; rows with a null label or doc_id are not learnt from; without positives, or without labels, every
score is 0; an empty table gives an empty result; other columns pass through, ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import CACHE_WORDS, lean_batches, mix, only_cache, trim, with_fields
from loadline.plans.staging import stage

HASH_BITS = 20
WORD = re.compile(r"[^\W_]+")
#: Words hashed at once.
LEARN_WORDS = 20_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) of every word: itself and its character n-grams, by rolling hashes over all words at once."""
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    number = np.arange(len(words), dtype=np.int32)
    owner = np.repeat(number, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters up to the word's end
    shift = np.uint64(64 - HASH_BITS)
    owners, found = [number], [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> shift]
    rolling = chars
    for n in range(2, min(6, len(chars)) + 1):
        rolling = rolling[:-1] * np.uint64(0x100000001B3) + chars[n - 1:]
        if n >= 3:
            inside = left[:len(rolling)] >= n
            owners.append(owner[:len(rolling)][inside])
            found.append(mix(rolling[inside] + np.uint64(n << 56)) >> shift)
    return np.concatenate(owners), np.concatenate(found).astype(np.int32)


class Features:
    """Features of a text through a worker's memory of words; ``chosen`` maps hashes to columns, -1 for none."""

    def __init__(self, chosen: np.ndarray | None = None) -> None:
        self.chosen = chosen
        self.known: dict[str, int] = {}
        only_cache(self.known)
        self.sets: list[np.ndarray] = [np.zeros(0, np.int32)]

    def learn(self, words: set[str]) -> None:
        if len(self.known) > (CACHE_WORDS if self.chosen is not None else CACHE_WORDS // 4):
            self.known.clear()
            self.sets = self.sets[:1]
        new = [w for w in words if w not in self.known]
        for lo in range(0, len(new), LEARN_WORDS):
            part = new[lo:lo + LEARN_WORDS]
            owner, found = word_features(part)
            if self.chosen is not None:
                found = self.chosen[found]
                owner, found = owner[found >= 0], found[found >= 0]
            order = np.argsort(owner, kind="stable")
            owner, found = owner[order], found[order]
            self.known.update(dict.fromkeys(part, 0))
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for i, own in zip(owner[np.r_[0, cuts]].tolist() if len(owner) else (), np.split(found, cuts)):
                self.known[part[i]] = len(self.sets)
                self.sets.append(own)

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(WORD.findall(text.lower())) if text else set()
        try:
            at = set(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            at = set(map(self.known.__getitem__, words))
        at.discard(0)
        return np.unique(np.concatenate([self.sets[i] for i in at])) if at else self.sets[0]


class Model:
    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.weights, self.bias = chosen, weights, bias


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-5,
             beta: float = 0.0, seed: int = 5, dims: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer; rows are 0/1 features, or bytes of ``dims`` packed bits, unpacked a step's rows at once."""
    rng = np.random.default_rng(seed)
    packed, dims = dims is not None, dims or positive.shape[1]
    w, b = np.zeros(dims, np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def some(rows, most):
        part = rows[rng.integers(len(rows), size=min(most, len(rows)))]
        return (np.unpackbits(part, axis=1, count=dims) if packed else part).astype(np.float32)

    for t in range(1, steps + 1):
        p, u = some(positive, 1000), some(unlabelled, 2000)
        zp, zu = p @ w + b, u @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        clean = np.log1p(np.exp(np.minimum(zu, 30))).mean() - prior * np.log1p(np.exp(np.minimum(zp, 30))).mean()
        up, down_p, down_u = (sp - 1) / len(p), sp / len(p), su / len(u)
        if clean < -beta:
            gp, gu = prior * down_p, -down_u
        else:
            gp, gu = prior * up - prior * down_p, down_u
        grad = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 6000, unlabelled: int = 12000,
          features: int = 1024) -> Model | None:
    """A model from ``labels`` (doc_id, toxic), or None without positives; ``prior`` defaults to the share of toxic labels."""
    lean_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labels")
    n, hits = known.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not hits:
        return None
    prior = min(0.5, max(0.01, hits / n)) if prior is None else prior
    order = F.xxhash64("id")
    drawn = (known.filter("toxic = 1").orderBy(order, "id").limit(positives).select("id", F.lit(1).alias("positive"))
             .union(known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled).select("id", F.lit(0))))
    # at most positives + unlabelled rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("id"))

    def extract(batches):
        read = Features()
        for batch in batches:
            found = [read(x.as_py()).astype(np.int32).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.binary())], ["positive", "found"])

    sample = stage(rows.select("positive", "text").mapInArrow(extract, "positive int, found binary"), "toxic-sample")

    def count(batches):
        total = np.zeros((2, 1 << HASH_BITS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for kind, found in zip(batch.column("positive").to_pylist(), batch.column("found")):
                total[kind][np.frombuffer(found.as_py(), np.int32)] += 1
                n[kind] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n), pa.array([x.astype(np.int32).tobytes() for x in total], pa.binary())],
                                         ["kind", "n", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int32) for x in part["counts"])
        return pd.DataFrame({"kind": [int(part["kind"].iloc[0])], "n": [int(part["n"].sum())], "counts": [total.astype(np.int32).tobytes()]})

    shape = "kind int, n long, counts binary"
    sums = {r["kind"]: (r["n"], np.frombuffer(r["counts"], np.int32)) for r in
            sample.coalesce(8).mapInArrow(count, shape).groupBy("kind").applyInPandas(add, shape).collect()}  # 2 rows
    if not sums or not sums[1][0] or not sums[0][0]:
        return None
    (nu, u), (npos, p) = sums[0], sums[1]
    share_p, share_u = (p + 0.5) / (npos + 1), (u + 0.5) / (nu + 1)
    strength = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) * (1 / npos + 1 / nu))
    strength[p + u < 5] = 0
    best = np.argsort(-strength, kind="stable")[:features]
    best = np.sort(best[strength[best] > 4])
    chosen = np.full(1 << HASH_BITS, -1, np.int32)
    chosen[best] = np.arange(len(best), dtype=np.int32)

    def select(batches):
        for batch in batches:
            out = []
            for found in batch.column("found"):
                own = chosen[np.frombuffer(found.as_py(), np.int32)]
                row = np.zeros(len(best), bool)
                row[own[own >= 0]] = True
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(out, pa.binary())], ["positive", "bits"])

    got = sample.mapInArrow(select, "positive int, bits binary").toArrow()  # the sample, features / 8 bytes a row
    if not len(best):
        return Model(chosen, np.zeros(0), float(np.log(prior / (1 - prior))))
    # the driver keeps the bits packed
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -1)
    kind = np.asarray(got.column("positive").combine_chunks())
    first = np.unpackbits(bits[:, :1], axis=1, count=min(8, len(best)))
    order = np.lexsort((*first.T, np.bitwise_count(bits).sum(1), kind))  # the same order however tasks were dealt
    bits, kind = bits[order], kind[order]
    weights, bias = fit_nnpu(bits[kind == 1], bits[kind == 0], prior, dims=len(best))
    trim()
    return Model(chosen, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 up)."""
    lean_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    held = docs.sparkSession.sparkContext.broadcast((model.chosen, model.weights, model.bias))
    shape = with_fields(docs, score="double", predicted="int")

    def run(batches):
        chosen, weights, bias = held.value
        read = Features(chosen)
        for batch in batches:
            z = np.array([bias + weights[read(x.as_py())].sum() for x in batch.column("text")], float)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], shape.names)

    return docs.mapInArrow(run, shape)
