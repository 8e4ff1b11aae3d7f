"""Periodic runs of words, by maximal pairs on a bottom-up LCP-interval tree.

A run is a stretch of consecutive words with smallest period q and length of at least max(``min_length``, 2 q)
that no neighbouring word extends with that period.

1. *Candidates.* In a run two places at distance q share at least ``min_length`` / 2 words, so only places whose
   n-gram of that many words comes again in their document can start one side of it.  Stretches around them,
   each closed by an end mark of its own, are all that is sorted.
2. *Suffix order.* Prefix doubling over many documents at once; a document's words are its own symbols, so documents never
   meet.  The ranks of all rounds give the LCP of neighbours.
3. *Tree.* LCP intervals are closed from the deepest up.  An interval of depth l holds the places of one string of l words
   as a list by position, every place with its left-word class.  Joining children, places that become neighbours
   in the list come from different children; they are a maximal pair (i, j, l) if their left-word classes
   differ.  With j - i <= l this pair is the run [i, j + l) of period j - i.

Nothing is extended: right-maximal since l is the LCP, left-maximal since the classes differ.  Neighbours suffice: were
another place of the string between i and j, both distances would be periods of overlapping copies, and
j - i not the smallest.  So each run comes up once.  Children are joined smaller into larger.

Every document is worked on by itself and nothing is shuffled; a task takes ``GROUP_WORDS`` words (or one longer document) at
a time.  Words are `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased unless ``lower`` is false, and are compared exactly.

Defined cases: null or empty texts, and texts of white space, have no runs and an empty collapsed text; rows with one
doc_id, or none, are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import CACHE_WORDS, byte_rows, lean_batches, mix, only_cache, words_of

#: Words that are sorted at once.
GROUP_WORDS = 400_000

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def repeated(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places whose k words come again in the same document (hash collisions may add some)."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(0, np.int64)
    gram = doc[:n].astype(np.uint64)
    for i in range(k):
        gram = mix(gram ^ words[i:n + i].astype(np.uint64)) + np.uint64(i)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    gram = gram[at]
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return at[again]


def stretches(words: np.ndarray, doc: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, origin): the places with the k words after them, and an end mark (origin -1) behind each stretch."""
    edge = np.zeros(len(words) + k + 2, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + k + 1, -1)
    kept = np.flatnonzero(np.cumsum(edge)[:len(words)] > 0)
    breaks = np.append((np.diff(kept) > 1) | (np.diff(doc[kept]) != 0), True)
    marks = int(breaks.sum())
    slot = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(breaks)[:-1]])
    symbols = np.empty(len(kept) + marks, np.int64)
    origin = np.full(len(symbols), -1, np.int64)
    symbols[slot] = marks + doc[kept].astype(np.int64) * (int(words.max()) + 1) + words[kept]
    origin[slot] = kept
    symbols[origin < 0] = np.arange(marks)
    return symbols, origin


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes in order and the words each shares with the one before it.

    Only suffixes that are not yet told apart are sorted again.  Every suffix ends in a mark of its own.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.append(True, symbols[order[1:]] != symbols[order[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    while True:
        at = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(at):
            break
        some = order[at]
        key = rank[some].astype(np.int64) * n + rank[some + step]
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        first[at] = np.append(True, key[1:] != key[:-1])
        rank[some] = np.maximum.accumulate(np.where(first[at], at, 0))
        step *= 2
        levels.append(rank.copy())
    lcp = np.zeros(n, np.int64)
    one, two, shared = order[:-1], order[1:], lcp[1:]
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels.pop()
        shared += (ranks[one + shared] == ranks[two + shared]).astype(np.int64) << level
    return order, lcp


class _Interval:
    """An open LCP interval: its depth, and the position lists of its children."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int, child: list[int]) -> None:
        self.depth, self.children = depth, [child]

    def close(self, left: dict[int, int], min_length: int, found: list[tuple[int, int, int]]) -> list[int]:
        """Join the children's lists; new neighbours of different left-word class are maximal pairs."""
        depth = self.depth
        children = sorted(self.children, key=len, reverse=True)
        places = children[0]
        owner: dict[int, int] = {}
        for number, child in enumerate(children[1:], 1):
            for x in child:
                owner[x] = number
        if len(owner) * 8 < len(places):
            for x in owner:
                places.insert(bisect_left(places, x), x)
        else:
            places = sorted(places + list(owner))
        for x, number in owner.items():
            at = bisect_left(places, x)
            # the place before x, whoever owns it; the place after x only if no later turn looks back from it
            for i, j in ((at - 1, at), (at, at + 1)):
                if i < 0 or j >= len(places):
                    continue
                lo, hi = places[i], places[j]
                if hi - lo > depth or hi - lo + depth < min_length or left[lo] == left[hi]:
                    continue
                if owner.get(lo if lo != x else hi, 0) == number or (j > at and hi in owner):
                    continue
                found.append((lo, hi - lo + depth, hi - lo))
        return places


def tree_runs(places: list[int], lcp: list[int], left: dict[int, int], min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) from one subtree: places in suffix order, lcp[i] shared with the place before."""
    found: list[tuple[int, int, int]] = []
    open_: list[_Interval] = []
    for x, depth in zip(places, [*lcp[1:], -1]):
        node = [x]
        while open_ and open_[-1].depth > depth:
            top = open_.pop()
            top.children.append(node)
            node = top.close(left, min_length, found)
        if depth < 0:
            break
        if open_ and open_[-1].depth == depth:
            open_[-1].children.append(node)
        else:
            open_.append(_Interval(depth, node))
    return found


def find_runs(words: np.ndarray, doc: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs, start counted over the whole array; ``doc`` ascends."""
    k = max(1, -(-min_length // 2))
    places = repeated(words, doc, k)
    if not len(places):
        return np.zeros((0, 3), np.int64)
    symbols, origin = stretches(words, doc, places, k)
    order, lcp = suffix_order(symbols)
    at = origin[order]
    deep = lcp >= k
    # a subtree: a place and all that follow it with at least k shared words
    member = deep | np.append(deep[1:], False)
    at, lcp, deep = at[member], lcp[member], deep[member]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    head = np.flatnonzero(~deep)
    tree = np.cumsum(~deep) - 1
    # no two places of a subtree as near as its deepest interval: no run in it
    by = np.lexsort((at, tree))
    gap = np.append(np.diff(at[by]), np.iinfo(np.int64).max)
    gap[np.append(head[1:], len(at)) - 1] = np.iinfo(np.int64).max
    least = np.minimum.reduceat(gap, head)
    deepest = np.maximum.reduceat(np.where(deep, lcp, 0), head)
    before = np.where((at > 0) & (doc[np.maximum(at - 1, 0)] == doc[at]), words[np.maximum(at - 1, 0)], -1)
    out: list[tuple[int, int, int]] = []
    for t in np.flatnonzero(least <= deepest):
        lo, hi = head[t], head[t + 1] if t + 1 < len(head) else len(at)
        own = at[lo:hi].tolist()
        out += tree_runs(own, lcp[lo:hi].tolist(), dict(zip(own, before[lo:hi].tolist())), min_length)
    runs = np.array(sorted(set(out)), np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbering() -> defaultdict:
    return defaultdict(count().__next__)


def periodic_runs(docs: DataFrame, min_length: int = 12, lower: bool = True) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per document.

    ``runs`` is an array of (start, length, period) by start, then period.  ``collapsed`` has the words joined by one space,
    without those that a run contains after its first period; with ``lower`` words are compared and returned lower-cased.
    """
    lean_batches(docs.sparkSession)

    def run(batches):
        only_cache({})
        number = _numbering()
        for batch in batches:
            texts: list[list[bytes]] = []
            ids, size = [], 0
            results: list[tuple[int, list, bytes]] = []

            def flush():
                if not texts:
                    return
                lengths = np.array([len(x) for x in texts])
                base = np.concatenate([[0], np.cumsum(lengths)])
                doc = np.repeat(np.arange(len(texts)), lengths)
                found = find_runs(np.concatenate(ids) if size else np.zeros(0, np.int64), doc, min_length)
                cuts = np.searchsorted(found[:, 0], base)
                for d, words in enumerate(texts):
                    own = found[cuts[d]:cuts[d + 1]] - [base[d], 0, 0]
                    if len(own):
                        drop = np.zeros(len(words) + 1, np.int64)
                        np.add.at(drop, own[:, 0] + own[:, 2], 1)
                        np.add.at(drop, own[:, 0] + own[:, 1], -1)
                        kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()
                        kept_words = [words[i] for i in kept]
                    else:
                        kept_words = words
                    results.append((len(words), [{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in own],
                                    b" ".join(kept_words)))

            for text in byte_rows(batch.column("text")):
                words = words_of(text, lower)
                if size and size + len(words) > GROUP_WORDS:
                    flush()
                    texts, ids, size = [], [], 0
                if len(number) > CACHE_WORDS:
                    number = _numbering()  # numbers only have to agree within a document
                texts.append(words)
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                size += len(words)
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in results], pa.int64()),
                 pa.array([r[1] for r in results], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array([r[2] for r in results], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
