"""Periodic runs, SimHash tiles and hard negatives against plain Python over all rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from loadline.llm import hard_negatives, queries, runs, simhash

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return re.findall("[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


# ---- periodic runs


def plain_runs(words, min_length=12):
    """(start, length, period) by definition: maximal stretches for every period, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        equal = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        while i < len(equal):
            if equal[i]:
                end = equal.index(False, i)
                if end + q - i >= max(min_length, 2 * q):
                    found.setdefault((i, end + q - i), q)
                i = end
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rng):
    letters = rng.choice([1, 2, 2, 3, 6, 60])
    words = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(0, 150))]
    for _ in range(rng.randrange(0, 3)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            for i in range(a, min(len(words), a + rng.randrange(60))):
                words[i] = words[a + (i - a) % p]
    return rng.choice([" ", "\n", " \t"]).join(words)


@pytest.mark.parametrize("min_length", [2, 5, 12])
def test_runs_equal_the_definition(spark, min_length, monkeypatch):
    rng = random.Random(min_length)
    rows = [(i, random_text(rng), "other") for i in range(250)]
    rows += [(300, None, None), (301, "", None), (302, " \n\t", None), (303, "a " * 5000, None), (304, "A b a B " * 9, None), (304, "A b a B " * 9, None),
             (None, "x y " * 8, None), (305, "É é " * 10, None), (306, "one", None)]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3), min_length).collect()
    assert len(got) == len(rows)
    seen = {r["doc_id"]: r for r in got}
    for doc_id, text, _ in rows:
        words = plain_words(text)
        expected = [(0, 5000, 1)] if doc_id == 303 else plain_runs(words, min_length)
        assert [tuple(x) for x in seen[doc_id]["runs"]] == expected
        assert seen[doc_id]["n_words"] == len(words)
        assert seen[doc_id]["collapsed"] == collapsed(words, expected)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(empty).collect() == []


def test_groups_of_documents_do_not_meet(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 4000)
    doc = np.repeat(np.arange(40), 100)
    whole = runs.find_runs(words, doc)
    for d in range(40):
        own = runs.find_runs(words[doc == d], np.zeros(100, int))
        assert (whole[(whole[:, 0] >= 100 * d) & (whole[:, 0] < 100 * d + 100)] - [100 * d, 0, 0]).tolist() == own.tolist()


def test_runs_of_words_that_differ_by_case(spark, tmp_path):
    rows = [(1, "Go go " * 8), (2, "go go " * 8), (4, "x " + "A b " * 7 + "a B"), (None, "UP down " * 6)]
    assert all(i is None or zlib.crc32(str(i).encode()) % 10 for i, _ in rows)
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, path).collect()}
    for doc_id, text in rows:
        words, r = text.split(), got[doc_id]
        found = plain_runs(words)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, *found[0])
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert (got[1]["period"], got[2]["period"], got[4]["length"], got[None]["length"]) == (2, 1, 14, 12)


def test_runs_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    assert any(r["n_runs"] for r in got.values())
    for doc_id, text in docs.items():
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        if len(words) > 1500:
            continue
        found, r = plain_runs(words), got[doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()


# ---- SimHash


def plain_fingerprint(text, k=4):
    words = plain_words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    ids, least = list(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= radius and least[b] > least[a]:
                    least[b], changed = least[a], True
    return least


def edited(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "edit"
    return " ".join(words)


@pytest.mark.parametrize("tile, large", [(8192, 1 << 20), (3, 4)], ids=["whole", "small-tiles"])
def test_simhash_equals_all_pairs(spark, monkeypatch, tile, large):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(900))
    texts = [base] + [edited(rng, base) for _ in range(40)] + [base.upper()] * 3
    texts += [" ".join(f"v{rng.randrange(9)}" for _ in range(rng.randrange(0, 30))) for _ in range(80)]
    texts += [None, "", " \t", "one two", "x " * 3000]
    rows = [(i * 7 % 1009, t, 0) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(4)).collect()
    prints = {i: plain_fingerprint(t) for i, t, _ in rows}
    least = plain_components(prints)
    assert {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in got} == {i: (prints[i], least[i]) for i in prints}
    assert len(set(least.values())) < len(rows) - 40


def test_close_rows_with_and_without_finer_counts(monkeypatch):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    two = np.concatenate([one[:100] ^ np.uint64(1 << 9 | 1 << 63), one[100:150], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])

    def pairs():
        return sorted((int(i), int(j)) for a, b in simhash.close_rows(one, two, 4) for i, j in zip(a, b))

    plain = pairs()
    monkeypatch.setattr(simhash, "LARGE", 0)
    assert pairs() == plain and len(plain) >= 150


def test_simhash_edges(spark):
    shape = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], shape)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, ""), (4, None), (4, "a b"), (None, "c d e f g h")], shape)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


# ---- hard negatives


def plain_negatives(rows, anchors, positives, negatives, low, high):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    dims = max((len(r[2]) for r in rows), default=0)
    vec = [np.array(list(r[2]) + [0] * (dims - len(r[2]))) for r in rows]
    out = set()
    for a in range(len(rows)):
        if rows[a][0] not in anchors:
            continue
        scored = sorted((-int(vec[a] @ vec[b]), rows[b][0], rows[b][1]) for b in range(len(rows)) if rows[b][0] != rows[a][0])
        for p, positive, _ in [x for x in scored if x[2] == rows[a][1]][:positives]:
            fit = [x for x in scored if x[2] != rows[a][1] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out |= {(rows[a][0], positive, rank, x[1], -p, -x[0]) for rank, x in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"fanout": 3, "depth": 3, "first_leaves": 1, "task_rows": 40, "task_anchors": 3, "sample": 60}], ids=["plain", "many-salts"])
def test_negatives_equal_all_pairs(spark, options):
    rng = np.random.default_rng(9)
    centres = rng.integers(-60, 60, (6, 8))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in centres[rng.integers(0, 6)] + rng.integers(-25, 25, 8)]) for i in range(400)]
    rows += [(1000 + i, i % 2, [float(x) for x in centres[0]]) for i in range(150)]  # one vector many times: ties
    rows += [(2000, None, [1.0] * 8), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 8), (2004, 2, [float("inf")]), (None, 1, [2.0]),
             (2010, 1, [50.0, 10.0]), (2020, 2, []), (2030, 0, [0.0] * 8), (2030 + 10, 7, [9.0] * 8)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, vec array<double>, leaf string").repartition(5)
    got = hard_negatives.mine(frame, frame.filter("vec_id % 10 = 0"), 5, 10, 30, 90, **options).collect()
    expected = plain_negatives(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0}, 5, 10, 30, 90)
    assert len(got) == len(expected)
    assert {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got} == expected


def test_negatives_edges(spark):
    shape = "vec_id long, label int, vec array<double>"
    empty = spark.createDataFrame([], shape)
    assert hard_negatives.mine(empty, empty).collect() == []
    twice = spark.createDataFrame([(1, 0, [3.0]), (1, 0, [3.0]), (2, 0, [2.0]), (3, 1, [1.0]), (3, 1, [1.0])], shape)
    got = sorted(tuple(r) for r in hard_negatives.mine(twice, twice.filter("vec_id = 1").union(twice.filter("vec_id = 1"))).collect())
    assert got == [(1, 2, 1, 3, 6, 3), (1, 2, 2, 3, 6, 3)]
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(1, 0, [1e9])], shape), empty)


def test_tree_leaves_out_far_subtrees(spark):
    """Ranges of well separated groups leave out the leaves of all other groups."""
    rng = np.random.default_rng(2)
    rows = [(g * 100 + i, 0, [float(x) for x in np.eye(6)[g] * 10_000 + rng.integers(-9, 9, 6)]) for g in range(6) for i in range(100)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, vec array<double>")
    tree = hard_negatives.Tree(frame, fanout=6, depth=1)
    asked = spark.createDataFrame([(0, 0, np.array(rows[0][2]).tobytes(), [9.0e7], [2.0e8])], "query_id long, label long, packed binary, low array<double>, high array<double>")
    assert len(tree.counts) == 6
    assert hard_negatives.visits(tree, asked, first=6, later=False).count() == 1
