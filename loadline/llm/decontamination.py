"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all words over all documents, in 2^``BUCKET_BITS`` hashed counters (4 MB).
2. Benchmark items are cut into passages of ``window`` words; their TF-IDF rows are written as a table, whole items dealt to
   spaces of about ``SPACE_PASSAGES`` passages.  For each space a distributed randomised SVD with power iterations gives its
   leading right singular vectors V, ``rank`` of them, at most a ``TRUNCATION``-th of the passages.
3. Every window of every document is compared with all passages in the latent space.  The space keeps a share of a passage,
   |V'a|^2 of 1, that differs between passages and falls as the benchmark grows; the score of a window w and a passage a is
   (V'a . V'w) / (|V'a|^2 |w|), so a verbatim copy scores 1 whatever was cut off.  Scores from ``cosine`` up are candidates.
   A word adds at most its weight times its largest entry in any scaled row of ``NEIGHBOURS`` passages; the sum of that over
   a window bounds its score with these passages from above, so windows left out can't be candidates.  The rest is projected
   and compared by one matrix product for many windows.
4. Overlapping candidate windows of an item are one stretch.  Every stretch is confirmed by the longest common
   subsequence of words with the item: at least ``sure`` of the item's words, or at least ``likely`` and most of
   the item's answer words.  The best confirmed stretch of a document and item is reported.

Words are lower-cased runs of letters and digits.  The benchmark is the stated query set, taken in blocks of
``block_items``, and in passes of spaces that take about ``PASS_MB``.  The answer is the item's ``answer``
column, or its last ``ANSWER_WORDS`` words where there is none.

Defined cases: null or wordless texts and items match nothing; repeated documents are each reported; items of one
item_id are one item (the smallest text and answer); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import byte_rows, lean_batches, mix, only_cache
from loadline.plans.staging import stage

BUCKET_BITS = 20
ANSWER_WORDS = 5
STRIDE = 8
PASS_MB = 128
SPACE_PASSAGES, TRUNCATION = 768, 2
#: Passages whose words' bounds are taken together.
NEIGHBOURS = 32
#: Most words times latent spaces whose bounds are summed at once, and windows compared at once.
CELLS, WINDOWS = 1_000_000, 2048
#: A-Z to a-z; ASCII signs to a space; bytes of other characters unchanged.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Base of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once.
HASH_BYTES = 1 << 16


def plain(text: str | bytes | None) -> bytes:
    """Lower-cased words of a text between spaces: only bytes of letters and digits, and spaces."""
    if not text:
        return b""
    data = text.encode() if isinstance(text, str) else text
    if not data.isascii():
        low = data.decode().lower()
        for c in set(low):
            if c > "\x7f" and not c.isalnum():
                low = low.replace(c, " ")
        data = low.encode()
    return data.translate(PLAIN)


def words(text: str | bytes | None) -> list[str]:
    return [w.decode() for w in plain(text).split()]


_powers = np.cumprod(np.full(HASH_BYTES, BASE, np.uint64))
_inverses = np.cumprod(np.full(HASH_BYTES, INVERSE, np.uint64))


def buckets(text: str | bytes | None) -> np.ndarray:
    """Hashed bucket of every word, in order, by a rolling hash over all bytes at once."""
    data = plain(text)
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + HASH_BYTES)
        if end < len(data):  # cut between words; a longer word is cut into pieces
            space = data.rfind(b" ", at, end)
            end = space if space > at else end
        part = np.frombuffer(data, np.uint8, end - at, at)
        inside = part != 32
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate([[0], change])
        if inside[-1]:
            change = np.concatenate([change, [len(part)]])
        starts, stops = change[::2], change[1::2]
        rolling = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _powers[:len(part)], dtype=np.uint64)])
        found.append(mix((rolling[stops] - rolling[starts]) * _inverses[starts]))
        at = end
    return (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) if found else np.zeros(0, np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + df)) of every bucket, over all documents."""

    def count(batches):
        only_cache({})
        total, n = np.zeros(1 << BUCKET_BITS, np.uint32), 0
        for batch in batches:
            for text in byte_rows(batch.column("text")):
                total[buckets(text)] += 1  # once a bucket, however often it is named
                n += 1
        if n:
            parts = total.reshape(16, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([n] * 16, pa.int64()),
                                              pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "n", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.float64) for x in rows["counts"])
        idf = np.log((1 + rows["n"].sum()) / (1 + total)).astype(np.float32)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "n": [int(rows["n"].sum())], "counts": [idf.tobytes()]})

    shape = "block int, n long, counts binary"
    done = docs.select("text").mapInArrow(count, shape).groupBy("block").applyInPandas(add, shape).collect()  # 16 rows, 4 MB
    out = np.zeros((16, (1 << BUCKET_BITS) // 16), np.float32)
    for block, _, part in done:
        out[block] = np.frombuffer(part, np.float32)
    return out.ravel()


def starts_of(n: int, window: int, stride: int) -> np.ndarray:
    """Window starts that cover n words, the last one flush with the end."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - window + 1, stride), n - window))


def passage_rows(text: str | None, idf: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, unit TF-IDF weights) of every passage of an item."""
    out = []
    b = buckets(text)
    for s in starts_of(len(b), window, window // 2) if len(b) else ():
        at, tf = np.unique(b[s:s + window], return_counts=True)
        value = tf * idf[at].astype(np.float64)
        out.append((at, value / (np.linalg.norm(value) or 1.0)))
    return out


def randomised_svd(passages: DataFrame, columns: int, rank: int, over: int = 16, turns: int = 2, own: np.ndarray | None = None) -> np.ndarray:
    """Leading right singular vectors (columns, rank) of sparse rows A (at array<int>, value array<double>).

    Tasks sum A'(A G) for a Gaussian G, and again for the orthonormal basis of that (``turns`` power iterations).
    ``own`` names the column of each sorted entry of ``at``, if these are no column numbers.
    """
    width = min(rank + over, columns)
    place = (lambda at: np.searchsorted(own, at)) if own is not None else np.asarray

    def spread(basis):
        def run(batches):
            start = basis if basis is not None else np.random.default_rng(3).standard_normal((columns, width))
            total = np.zeros((columns, start.shape[1]))
            for batch in batches:
                for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist()):
                    at, v = place(at), np.array(value)
                    total[at] += v[:, None] * (v @ start[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
        return run

    def gram(basis):
        def run(batches):
            total = np.zeros((basis.shape[1], basis.shape[1]))
            for batch in batches:
                for at, value in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist()):
                    y = np.array(value) @ basis[place(at)]
                    total += np.outer(y, y)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])
        return run

    def summed(parts: DataFrame, rows: int) -> np.ndarray:
        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [sum(np.frombuffer(x) for x in rows["part"]).tobytes()]})

        some = parts.groupBy(F.spark_partition_id() % 2).applyInPandas(add, "part binary").collect()  # 2 partial sums
        return sum(np.frombuffer(r[0]) for r in some).reshape(rows, -1)

    basis = None
    for _ in range(1 + turns):
        basis, _ = np.linalg.qr(summed(passages.mapInArrow(spread(basis), "part binary"), columns))
    value, vector = np.linalg.eigh(summed(passages.mapInArrow(gram(basis), "part binary"), basis.shape[1]))
    lead = np.argsort(-value)[:rank]
    return basis @ vector[:, lead[value[lead] > 1e-9]]


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def confirm(item: list[str], answer: list[str], text: list[str], first: int, last: int, sure: float, likely: float) -> tuple[float, bool] | None:
    """Best confirmed share of the item's words in order near ``text[first:last]``, and whether the answer is there; None if there is none.

    Words in any order bound the share from above, so parts with too few of them are passed over.
    """
    n = len(item)
    size = n + n // 4 + 2
    least = min(sure, likely)
    low, high = max(0, first - n), min(len(text), last + n)
    if (Counter(item) & Counter(text[low:high])).total() / n < least:
        return None
    known = set(item)
    count = np.r_[0, np.cumsum([w in known for w in text[low:high]])]
    best = None
    for s in range(low, max(low + 1, high - n + 1), max(1, n // 8)):
        e = min(s + size, high)
        most = int(count[e - low] - count[s - low]) / n
        if most < least or (best and most < best[0]):
            continue
        part = text[s:e]
        share = common_length(item, part) / n
        if share < least or (best and share < best[0]):
            continue
        there = 10 * common_length(answer, part) >= 6 * len(answer)
        if share >= sure or (share >= likely and there):
            best = max(best or (share, there), (share, there))
    return best


def stretches(windows: list[tuple[int, float]], window: int) -> list[tuple[int, int, float]]:
    """(first, last, cosine) of overlapping or touching windows (start, cosine); the greatest cosine."""
    out: list[tuple[int, int, float]] = []
    for s, c in sorted(windows):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window, max(out[-1][2], c))
        else:
            out.append((s, s + window, c))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 32, rank: int = 256, cosine: float = 0.4, sure: float = 0.75,
               likely: float = 0.6, block_items: int = 5000) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer_found) of every document and item that it contains."""
    spark = docs.sparkSession
    lean_batches(spark)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", "text", answer.alias("answer")).filter("item_id IS NOT NULL").groupBy("item_id").agg(
        F.min("text").alias("text"), F.min("answer").alias("answer"))
    items = stage(items, "benchmark")
    n_items = items.count()
    shape = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean"
    found = spark.createDataFrame([], shape)
    if not n_items:
        return found
    idf = inverse_frequencies(docs)
    blocks = -(-n_items // block_items)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)  # about block_items
        full = {r["item_id"]: (own, words(r["answer"]) or own[-ANSWER_WORDS:]) for r in part.collect() if (own := words(r["text"]))}
        for spaces in in_passes(latent_spaces(part, idf, window, rank)):
            found = found.union(_search(docs, spaces, full, idf, window, cosine, sure, likely, shape))
    return found


class Space:
    """A latent space: its words' buckets, their right singular vectors, the passages' scaled latent rows and items."""

    def __init__(self, own: np.ndarray, vectors: np.ndarray, items: list[int], latent: np.ndarray) -> None:
        self.own, self.vectors, self.items = own, vectors.astype(np.float32), items
        kept = (latent ** 2).sum(1, keepdims=True)  # of 1
        self.latent = (latent / np.maximum(kept, 1e-6)).astype(np.float32)

    def most(self) -> np.ndarray:
        """What each word adds at most to a score with any of ``NEIGHBOURS`` passages, for each unit of weight; a column a group."""
        starts = np.arange(0, len(self.items), NEIGHBOURS)
        out = np.zeros((len(self.own), len(starts)), np.float32)
        for lo in range(0, len(self.own), 4096):
            out[lo:lo + 4096] = np.maximum(np.maximum.reduceat(self.vectors[lo:lo + 4096] @ self.latent.T, starts, axis=1), 0)
        return out


def latent_spaces(items: DataFrame, idf: np.ndarray, window: int, rank: int) -> list[Space]:
    """Spaces of about ``SPACE_PASSAGES`` passages of whole items."""
    held = items.sparkSession.sparkContext.broadcast(idf)

    def cut(batches):
        for batch in batches:
            rows = [(i, *p) for i, text in zip(batch.column("item_id").to_pylist(), byte_rows(batch.column("text"))) for p in passage_rows(text, held.value, window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                                              pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["item_id", "at", "value"])

    passages = stage(items.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, at array<int>, value array<double>"), "passages")
    n = passages.count()
    spaces = []
    count = -(-n // SPACE_PASSAGES)
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, count)))
    for number in range(count):
        part = passages.filter(dealt == number)
        own = np.sort(np.array([r[0] for r in part.select(F.explode("at")).distinct().collect()], np.int64))  # words of a space
        size = part.count()
        if not size:
            continue
        vectors = randomised_svd(part, len(own), min(rank, max(1, -(-size // TRUNCATION))), own=own)

        def project(batches, own=own, vectors=vectors):
            for batch in batches:
                rows = [(np.array(v) @ vectors[np.searchsorted(own, at)]).astype(np.float64).tobytes()
                        for at, v in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(rows, pa.binary())], ["item_id", "row"])

        got = part.select("item_id", "at", "value").mapInArrow(project, "item_id long, row binary").collect()  # rank numbers a passage
        got.sort(key=lambda r: r[0])  # passages of one item are neighbours
        spaces.append(Space(own, vectors, [r[0] for r in got], np.stack([np.frombuffer(r[1]) for r in got])))
    return spaces


def in_passes(spaces: list[Space]) -> list[list[Space]]:
    """Spaces in groups of about ``PASS_MB``; only a single space can take more."""
    passes: list[list[Space]] = []
    size = 0
    for space in spaces:
        own = space.vectors.nbytes + space.latent.nbytes
        if not passes or size + own > PASS_MB * (1 << 20):
            passes.append([])
            size = 0
        passes[-1].append(space)
        size += own
    return passes


def _search(docs, spaces, full, idf, window, cosine, sure, likely, shape) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate([s.own for s in spaces]))
    place = np.full(1 << BUCKET_BITS, len(vocabulary), np.int32)  # the last place stands for all other words
    place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    bounds = [s.most() * idf[s.own][:, None] for s in spaces]
    group_of = np.repeat(np.arange(len(spaces)), [b.shape[1] for b in bounds])  # the space of each group of passages
    gain = np.zeros((len(vocabulary) + 1, len(group_of)), np.float32)
    column = np.full((len(spaces), len(vocabulary) + 1), -1, np.int32)
    for k, s in enumerate(spaces):
        at = np.searchsorted(vocabulary, s.own)
        gain[np.ix_(at, np.flatnonzero(group_of == k))] = bounds[k]
        column[k, at] = np.arange(len(s.own), dtype=np.int32)
    here = {i for s in spaces for i in s.items}
    held = spark.sparkContext.broadcast((idf, place, gain, group_of, column, spaces, {i: x for i, x in full.items() if i in here}))

    def run(batches):
        only_cache({})
        idf, place, gain, group_of, column, spaces, full = held.value
        kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer_found", pa.bool_())])
        for batch in batches:
            texts = list(byte_rows(batch.column("text")))
            near: dict[int, dict[int, dict[int, float]]] = {}  # text -> item -> start of a window -> score
            waiting: list[list] = [[] for _ in spaces]

            def compare(k: int) -> None:
                if not waiting[k]:
                    return
                close = np.stack([z for _, _, z in waiting[k]]) @ spaces[k].latent.T
                for w, p in zip(*np.nonzero(close >= cosine)):
                    row, start, _ = waiting[k][w]
                    at = near.setdefault(row, {}).setdefault(spaces[k].items[p], {})
                    at[start] = max(at.get(start, 0.0), float(close[w, p]))
                waiting[k].clear()

            for row, text in enumerate(texts):
                b = buckets(text)
                if not len(b):
                    continue
                weight = idf[b].astype(np.float64)
                at = place[b]
                starts = starts_of(len(b), window, STRIDE)
                ends = np.minimum(starts + window, len(b))
                every = np.r_[0, np.cumsum(weight * weight)]
                norm = np.sqrt(every[ends] - every[starts])
                need = (cosine - 1e-4) * norm
                weight = weight.astype(np.float32)
                step = max(1, CELLS // len(b))
                near_space = np.zeros((len(starts), len(spaces)), bool)
                for lo in range(0, len(group_of), step):
                    reach = np.zeros((len(b) + 1, min(step, len(group_of) - lo)))
                    np.cumsum(gain[at, lo:lo + step], axis=0, dtype=float, out=reach[1:])
                    j, g = np.nonzero((reach[ends] - reach[starts] >= need[:, None]) & (norm > 0)[:, None])
                    near_space[j, group_of[lo + g]] = True
                for j, k in zip(*np.nonzero(near_space)):
                    s, e = starts[j], ends[j]
                    c = column[k, at[s:e]]
                    known = c >= 0
                    waiting[k].append((row, int(s), weight[s:e][known] @ spaces[k].vectors[c[known]] / np.float32(norm[j])))
                    if len(waiting[k]) == WINDOWS:
                        compare(k)
            for k in range(len(spaces)):
                compare(k)
            out = []
            ids = batch.column("doc_id").to_pylist()
            for row, by_item in near.items():
                own = words(texts[row])
                for i, windows in by_item.items():
                    item, answer = full[i]
                    leaks = [(*leak, c) for first, last, c in stretches(list(windows.items()), window)
                             if (leak := confirm(item, answer, own, first, last, sure, likely))]
                    if leaks:
                        share, there, c = max(leaks)
                        out.append({"doc_id": ids[row], "item_id": i, "cosine": c, "lcs": share, "answer_found": there})
            yield pa.RecordBatch.from_pylist(out, kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, shape)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that contain no benchmark item; a null doc_id stays."""
    gone = stage(find_leaks(docs, benchmark, **options), "leaks").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
