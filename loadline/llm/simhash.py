"""SimHash near duplicates by exact comparison of tiles.

1. *Fingerprints.* XXH64 of every word n-gram of a text, repeats included; a bit of the fingerprint is 1 if more than half
   of the hashes have it.
2. *Tiles.* Distinct fingerprints, sorted by their population counts in ``PARTS`` bit ranges, are cut into tiles of at
   most ``TILE`` fingerprints with equal counts.  Two fingerprints within the radius differ by at most the radius in
   the sum of their counts' differences, so a tile only meets tiles of near counts, each pair of tiles once.
   Counts that a third of all rows share are many tiles; the sort is range-partitioned and splits them.
3. *Comparison.* A pair of tiles is compared whole, with exclusive-or and bit counts in numpy.  Inside large tiles rows
   are grouped by finer counts and groups whose counts differ beyond the radius are skipped as well.
4. *Components.* A pair of tiles returns no list of links but its connected groups, as links of rows to the first row of
   their group: at most one a row.  These links make the components.

The comparison is exact, with no cap on partners; it is quadratic in the number of distinct fingerprints, of which the
counts leave about a fifth (3 parts) of the tile pairs and, inside large tiles, 3 % of the row pairs.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other; fewer than ``k``
words count as one n-gram; equal texts have one fingerprint and one component; a row without doc_id gets the component of
its fingerprint, null if no row of the component has a doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import byte_rows, components, lean_batches, only_cache, words_of
from loadline.plans.staging import stage

#: Bit ranges whose population counts key a tile, and the finer ranges for large tiles.
PARTS = ((0, 21), (21, 42), (42, 64))
FINE = ((0, 10), (10, 21), (21, 31), (31, 42), (42, 53), (53, 64))
#: Most fingerprints of a tile (8 bytes each).
TILE = 8192
#: Hashes whose bits are counted at once (64 bytes each).
CHUNK = 1 << 16
#: Rows of one side compared at once, and pairs of rows from which finer counts are used.
STRIP, LARGE = 256, 1 << 20


def bit_mask(lo: int, hi: int) -> int:
    """Bits lo to hi - 1 as a signed 64-bit integer."""
    mask = (1 << hi) - (1 << lo)
    return mask - (1 << 64) if mask >> 63 else mask


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined k-word n-grams, in order; fewer words: of the whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(text[s:e], seed) for s, e in zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[lo:lo + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint) of every row, the fingerprint as a signed long."""
    lean_batches(docs.sparkSession)

    def run(batches):
        only_cache({})
        for batch in batches:
            found = [majority(shingle_hashes(words_of(x), k, seed)) for x in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def cell_of(fingerprint: str) -> Column:
    """The counts of ``PARTS`` as one number, with room for the radius on both sides of a count."""
    cell = F.lit(0)
    for lo, hi in PARTS:
        cell = cell * 256 + F.bit_count(F.col(fingerprint).bitwiseAND(F.lit(bit_mask(lo, hi)))) + 64
    return cell.cast("long")


def offsets(radius: int) -> list[int]:
    """Differences of cells within the radius, of two opposite ones the one that is not negative."""
    steps = [(x, y, z) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) for z in range(-radius, radius + 1)
             if abs(x) + abs(y) + abs(z) <= radius]
    return sorted(c for x, y, z in steps if (c := (x * 256 + y) * 256 + z) >= 0)


def tiles(classes: DataFrame) -> DataFrame:
    """(tile, cell, packed): sorted distinct fingerprints in tiles, named by their first."""

    def cut(batches: Iterator[pa.RecordBatch]):
        cell, held = None, []

        def out():
            rows = np.concatenate(held)
            return [(int(rows[i]), int(cell), rows[i:i + TILE].tobytes()) for i in range(0, len(rows), TILE)]

        for batch in batches:
            done = []
            cells, prints = np.asarray(batch.column("cell")), np.asarray(batch.column("fingerprint"))
            edges = np.flatnonzero(np.diff(cells)) + 1
            for own, at in zip(np.split(prints, edges), np.concatenate([[0], edges])):
                if not len(own):
                    continue
                if cells[at] != cell:
                    if held:
                        done += out()
                    cell, held = cells[at], []
                held.append(own)
                if sum(map(len, held)) >= TILE:
                    *full, rest = out()
                    if len(rest[2]) == 8 * TILE:
                        full.append(rest)
                        held = []
                    else:
                        held = [np.frombuffer(rest[2], np.int64)]
                    done += full
            if done:
                yield tile_rows(done)
        if held:
            yield tile_rows(out())

    keyed = classes.select("fingerprint", cell_of("fingerprint").alias("cell"))
    sorted_ = keyed.repartitionByRange("cell", "fingerprint").sortWithinPartitions("cell", "fingerprint")
    return stage(sorted_.mapInArrow(cut, "tile long, cell long, packed binary"), "tiles")


def tile_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        ["tile", "cell", "packed"])


def counts(rows: np.ndarray) -> np.ndarray:
    """Population counts of the finer bit ranges, one column each."""
    return np.stack([np.bitwise_count(rows & np.uint64((1 << hi) - (1 << lo))) for lo, hi in FINE], 1).astype(np.int16)


def close_rows(one: np.ndarray, two: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that differ in at most ``radius`` bits, some at a time."""
    def compare(a: np.ndarray, b: np.ndarray):
        for lo in range(0, len(a), STRIP):
            part = a[lo:lo + STRIP]
            r, c = np.nonzero(np.bitwise_count(one[part][:, None] ^ two[b][None]) <= radius)
            if len(r):
                yield part[r], b[c]

    if len(one) * len(two) < LARGE:
        yield from compare(np.arange(len(one)), np.arange(len(two)))
        return
    groups_one, of_one = np.unique(counts(one), axis=0, return_inverse=True)
    groups_two, of_two = np.unique(counts(two), axis=0, return_inverse=True)
    by = np.argsort(of_one.ravel(), kind="stable")
    cuts = np.searchsorted(of_one.ravel()[by], np.arange(len(groups_one) + 1))
    for g, key in enumerate(groups_one):
        near = np.abs(groups_two - key).sum(1) <= radius
        other = np.flatnonzero(near[of_two.ravel()])
        if len(other):
            yield from compare(by[cuts[g]:cuts[g + 1]], other)


def groups(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """The first row of each row's connected group; rows of ``two`` are numbered after those of ``one``."""
    first = np.arange(len(one) + len(two))
    for a, b in close_rows(one, two, radius):
        b = b + len(one)
        while True:
            a, b = first[a], first[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
            while (first[first] != first).any():
                first = first[first]
    return first


def links(tile_table: DataFrame, radius: int) -> DataFrame:
    """(a, b): fingerprints joined to the first of their group in a pair of tiles."""
    near = F.explode(F.array(*[F.lit(x).cast("long") for x in offsets(radius)]))
    visits = tile_table.select(F.col("tile").alias("tile2"), F.col("packed").alias("packed2"), F.col("cell").alias("cell2"), near.alias("step"))
    visits = visits.withColumn("target", F.col("cell2") + F.col("step"))
    met = tile_table.join(visits, (F.col("cell") == F.col("target")) & ((F.col("step") > 0) | (F.col("tile") <= F.col("tile2"))))

    def run(batches):
        for batch in batches:
            left, right = [], []
            for x, y, same in zip(batch.column("packed"), batch.column("packed2"), batch.column("same").to_pylist()):
                one = np.frombuffer(x.as_py(), np.uint64)
                two = one[:0] if same else np.frombuffer(y.as_py(), np.uint64)
                first = groups(one, one if same else two, radius)
                if same:
                    first = first[:len(one)]
                both = np.concatenate([one, two]).view(np.int64)
                far = np.flatnonzero(first != np.arange(len(first)))
                left.append(both[far])
                right.append(both[first[far]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    pairs = met.select("packed", "packed2", (F.col("tile") == F.col("tile2")).alias("same"))
    return stage(pairs.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, k: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; rows with one fingerprint are one class.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach.
    """
    rows = stage(fingerprints(docs, k, seed), "fingerprints")
    classes = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    group = components(links(tiles(classes), radius))
    named = classes.join(group, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("print"), "rep", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("component_id"))
    named = stage(named.join(least, F.col("component") == F.col("of")).select("print", "component_id"), "named")
    return rows.join(named, F.col("fingerprint") == F.col("print")).select("doc_id", "fingerprint", "component_id")
