"""Helpers that several operators share: word hashing, prefix sums, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadline.plans.staging import stage

#: A-Z to a-z, all other bytes unchanged (so UTF-8 text stays valid).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The white space of `[\x20\x09-\x0D]`.
SPACE = b" \t\n\x0b\x0c\r"
#: Most entries of a worker's word cache; a full cache is emptied, results do not change.
CACHE_WORDS = 300_000

_caches: list[dict] = []


def trim() -> None:
    """Give freed memory of this process back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def only_cache(mine: dict) -> None:
    """A worker serves tasks of many stages: empty and forget the word caches of all others, and give back free memory."""
    for other in _caches:
        if other is not mine:
            other.clear()
    _caches[:] = [mine]
    pa.default_memory_pool().release_unused()
    trim()


def lean_batches(spark: SparkSession) -> None:
    """Texts can be long: hand tasks at most 1000 of them and about 8 MB at once, on both sides of the JVM.

    Only lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``; results do not depend on them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > 1000:
        spark.conf.set(key, "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z lower-cased unless ``lower`` is false."""
    return (text.translate(LOWER) if lower else text).split() if text else []


class WordHashes:
    """64-bit hash of each word, remembered per worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the sequence as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out ^ hashes[i:n - k + 1 + i]) + np.uint64(i)
    return np.unique(out)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as bytes without decoding."""
    return column.cast(pa.binary())


def byte_rows(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in binary(column))


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, keys: tuple[str, ...] = (),
                name: str = "prefix") -> DataFrame:
    """Exclusive prefix sums of ``value`` in the given total order (per ``keys``).

    A range-partitioned sort splits hot keys as well; each range is summed alone and the
    totals of earlier ranges (one row per range and key) are joined back.
    """
    part = "_range"
    keys = list(keys)
    ranged = stage(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), name)
    totals = ranged.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col(part).alias("_at"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(base, [F.col(part) == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]])
            .withColumn(out, (F.col(out) + F.col("_base")).cast("long"))
            .drop(part, "_base", "_at", *[f"_k_{c}" for c in keys]))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star steps.  Each step takes a partially aggregated
    minimum per node and joins it back, so a hub is split by the adaptive skew join and no
    task gathers a neighbourhood.  Every round is written to the shared folder; the rounds end
    as soon as every edge leads straight to the smallest node of its component.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(e: DataFrame, of: DataFrame) -> DataFrame:
        least = of.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        return e.join(least, e.a == least.n)

    def flat(e: DataFrame) -> bool:
        """Every node has one smaller neighbour, or only larger ones."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]

    now = stage(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    while not flat(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = stage(tidy(large), "large-star")
        small = star(large, large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(tidy(small.select("e.*")), "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def more_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known`` (node, component) after more ``edges`` (a, b): only edges between components are followed."""
    of_a = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(between)
    if up.isEmpty():
        return known
    above = up.select(F.col("node").alias("at"), F.col("component").alias("top"))
    moved = known.join(above, F.col("component") == F.col("at"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return stage(moved.union(up.join(known, "node", "left_anti")), "components")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` with fields added or replaced (name="type")."""
    kept = [f for f in df.schema.fields if f.name not in fields]
    return T.StructType(kept + [T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])
