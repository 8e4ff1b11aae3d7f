"""Near copies, packing, LM scores, toxicity, decontamination, HTML and the pipeline against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loadline.llm import common, decontamination, html_extract, lm, near_join, packing, toxicity
from loadline.plans.staging import stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def invented(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def plain_components(rows, k, num, den):
    """{doc_id: (set size, smallest doc_id reachable)}, from all pairs."""
    sets = {}
    for i, text in rows:
        own = plain_words(text)
        n = min(k, len(own))
        sets[i] = {tuple(own[j:j + n]) for j in range(len(own) - n + 1)} if own else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    """Chains, exact copies, a group that edits one original, short, empty and very long texts."""
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "two words"), (5, "Two  WORDS"), (6, "one"), (7, "two words more")]
    base = invented(rng, 120).split()
    rows += [(10 + i, " ".join(base)) for i in range(5)]
    for i in range(30):
        own = list(base)
        for _ in range(rng.randrange(1, 8)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(own)))
    chain = invented(rng, 200).split()
    for i in range(12):  # neighbours link, the ends do not
        chain = chain[6:] + invented(rng, 6).split()
        rows.append((200 + i, " ".join(chain)))
    rows += [(300 + i, invented(rng, rng.randrange(1, 90))) for i in range(60)]
    rows += [(400 + i, "the same opening of many texts " * 2 + invented(rng, 30)) for i in range(40)]
    long = invented(rng, 20000)
    return rows + [(500, long), (501, long + " tail"), (502, long.upper())]


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_near_join_equals_all_pairs(spark, k, num, den):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_join.similar(docs, k, num, den).collect()}
    want = plain_components(rows, k, num, den)
    assert got == want
    kept = near_join.keep_one(docs, k, num, den)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_join_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_join.similar(docs).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(1, 1), (1, 1), (2, 1)]
    assert near_join.similar(docs.limit(0)).count() == 0


def packing_rows():
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (3, "It's 2024: don't, café İx <|x|> \U0001f600"), (4, "é combining"), (5, invented(rng, 6000)), (5, "again")]
    return rows + [(10 + i, invented(rng, rng.randrange(300))) for i in range(60)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing_rows()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    pieces = packing.pack(docs, TOKENIZER, length=2048).cache()
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * r["length"] else np.uint32).tolist()
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 2048
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    whole = sorted((i, [x for _, part in sorted(parts) for x in part]) for (i, _), parts in got.items())
    want = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    assert whole == sorted(want)
    placed = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces.collect())
    at = 0
    for sequence, offset, length in placed:  # one stream without gaps
        assert sequence * 2048 + offset == at
        at += length
    padded = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 2048 for r in padded) and sum(r["n_tokens"] for r in padded) == at
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("broadcast_mb", [192, 0])
def test_lm_base_score_is_exact(spark, broadcast_mb):
    """Also with a filter group, and so a pass, for every shard."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["The", "the", "a", "cat", "sat", "on", f"z{rng.randrange(50)}"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    texts += [(200, None), (201, ""), (202, "never seen words"), (203, "The cat " * 9000), (203, "the cat")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, score string")
    train = docs.filter("doc_id % 7 <> 2")
    counts, pairs = Counter(), Counter()
    for i, t in texts:
        if i % 7 != 2:
            own = plain_words(t) + ["\n"]
            counts.update(own)
            pairs.update(zip(["\t", *own], own))
    n, v = sum(counts.values()), len(counts)
    got = lm.score_texts(docs, train, shards=4, broadcast_mb=broadcast_mb).collect()
    found = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    want = []
    for i, t in texts:
        own = plain_words(t) + ["\n"]
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert found == sorted(want)
    by = {(r["doc_id"], r["n_tokens"]): r["score"] / r["n_tokens"] for r in got}
    assert by[203, 3] > by[202, 4] and all(x <= 0 for x in by.values())
    assert lm.score_texts(docs.limit(0), train, shards=4).count() == 0
    untrained = lm.score_texts(docs, train.limit(0), shards=4).collect()
    assert len(untrained) == len(texts) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)


def plain_scores(train, texts, mu):
    """Smoothed log10 probabilities from exact counts of words and pairs."""
    one, two = Counter(), Counter()
    for t in train:
        own = [*plain_words(t), 0]
        one.update(own)
        two.update(zip([1, *own], own))
    whole = sum(one.values()) + len(one) + 1
    before = one | Counter({1: len(train)})
    out = []
    for t in texts:
        own = [*plain_words(t), 0]
        out.append(sum(math.log10((two[v, w] + mu * (one[w] + 1) / whole) / (before[v] + mu)) for v, w in zip([1, *own], own)))
    return out


@pytest.mark.parametrize("shards, broadcast_mb", [(None, 192), (7, 0)])
def test_lm_score_is_near_the_unquantised_model(spark, monkeypatch, shards, broadcast_mb):
    monkeypatch.setattr(lm, "SHARD_BYTES", 2000)  # several shards also where their number follows from the text
    rng = random.Random(40)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(300)] + ["", None, "never seen words"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id < 200")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, train, mu=100.0, shards=shards, broadcast_mb=broadcast_mb).collect()}
    want = plain_scores(texts[:200], texts, 100.0)
    for i, x in enumerate(want):
        # a level spans a factor of 1.5 for pairs and 1.1 for words: at most log10(1.25) + 2 log10(1.05) a token
        assert abs(got[i] - x) <= 0.14 * (len(plain_words(texts[i])) + 1), (i, got[i], x)
    assert abs(sum(got.values()) - sum(want)) <= 0.02 * abs(sum(want))  # counts are never read too low, some too high


def test_bloom_counts_are_never_low(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"k{int(x)}" for x in rng.zipf(1.4, 400) if x < 2000) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    filters = lm.build_filter(lm.count_ngrams(docs, 3)).cache()
    sizes = filters.selectExpr("shard", "length(cells) AS cells", "distinct", "total").collect()
    model = lm.Group(lm.gathered(filters, sizes), 3)
    counts = Counter(w for t in texts for w in plain_words(t))
    words = [w.encode() for w in counts]
    at = model.look(words)
    exact = np.array([counts[w.decode()] for w in words])
    assert (model.table[0, at] == exact).all()
    owner = lm.shard_of(model.hash[at], 3).astype(np.int64)
    level = model.probe(model.hash[at], owner)
    assert (level >= lm.quantised(exact, lm.WORD_BASE)).all()
    assert (level == lm.quantised(exact, lm.WORD_BASE)).mean() > 0.95


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    bad = ["vile", "scum", "loathsome", "wretch", "filth"]
    rows, labels = [], []
    for i in range(1200):
        toxic = int(rng.random() < 0.2)
        own = invented(rng, 30, 400).split()
        if toxic:
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(bad)
        rows.append((i, " ".join(own), "s"))
        labels.append((i, toxic))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "calm " * 20000, "s"), (None, "vile scum filth", "s"), (3, rows[3][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    frame = spark.createDataFrame([(i, t) for i, t in labels if i not in held] + [(None, 1), (7000, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, frame)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    truth = dict(labels)
    pos, neg = [score[i] for i in held if truth[i]], [score[i] for i in held if not truth[i]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97
    assert np.mean([n >= 0.5 for n in neg]) < 0.03 and np.mean([p >= 0.5 for p in pos]) > 0.8
    assert score[5000] == score[5001] and score[5002] < 0.5
    nothing = toxicity.score(docs, toxicity.train(docs, frame.filter("toxic = 0")))
    assert {(r["score"], r["predicted"]) for r in nothing.collect()} == {(0.0, 0)}
    assert toxicity.train(docs, frame.limit(0)) is None
    assert toxicity.score(docs.limit(0), toxicity.train(docs, frame)).count() == 0


def test_nnpu_finds_the_feature():
    rng = np.random.default_rng(1)
    pos, mix = rng.random((300, 6)) < 0.3, rng.random((900, 6)) < 0.3
    pos[:, 2] = True
    mix[:, 2] = rng.random(900) < 0.2
    w, b = toxicity.fit_nnpu(pos, mix, 0.2, steps=400)
    assert w.argmax() == 2 and w[2] + b > 0 > b


@pytest.mark.parametrize("dims", [3, 20])
def test_nnpu_of_packed_rows_is_the_same(dims):
    rng = np.random.default_rng(1)
    pos, mix = rng.random((50, dims)) < 0.6, rng.random((80, dims)) < 0.3
    w, b = toxicity.fit_nnpu(pos, mix, 0.2, steps=40)
    v, c = toxicity.fit_nnpu(np.packbits(pos, axis=1), np.packbits(mix, axis=1), 0.2, steps=40, dims=dims)
    assert (w == v).all() and b == c


def least_reachable(edges):
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_components_end_when_all_edges_lead_to_the_smallest_node(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "stage", lambda df, name="stage": (written.append(name), stage(df, name))[1])
    star = [(n, 1) for n in range(2, 30)] + [(41, 40), (40, 40)]
    got = common.components(spark.createDataFrame(star, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == least_reachable(star[:-1])
    assert written == ["edges"]
    written.clear()
    hub = [(n, 20) for n in range(2, 30) if n != 20] + [(50, 50 + n) for n in range(1, 4)]
    got = common.components(spark.createDataFrame(hub, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == least_reachable(hub) and len(got) == len(least_reachable(hub))
    assert written.count("small-star") == 1
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_edges_change_only_the_components_they_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    old, new = ([(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2)) if a != b] for n in (25, 15))
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    known = stage(common.components(frame(old)), "known")
    got = common.more_components(known, frame(new)).collect()
    assert {r["node"]: r["component"] for r in got} == least_reachable(old + new) and len(got) == len(least_reachable(old + new))
    inside = [(a, least_reachable(old)[a]) for a, _ in old]
    written = []
    monkeypatch.setattr(common, "stage", lambda df, name="stage": (written.append(name), stage(df, name))[1])
    assert common.more_components(known, frame(inside)) is known and written == ["edges"]


def test_leaks_and_paraphrases(spark):
    rng = random.Random(10)
    items = [(i, invented(rng, 45, 4000)) for i in range(12)] + [(90, None), (91, " .,- ")]
    text = dict(items)

    def paraphrase(t):
        own = t.split()
        for at in sorted(rng.sample(range(len(own) - 6), 5), reverse=True):
            own[at:at + 1] = [] if at % 2 else ["other", own[at]]
        return " ".join(own)

    rows = [(i, invented(rng, 150, 4000), "c") for i in range(60)]
    rows += [(100 + i, f"{invented(rng, 70, 4000)} {text[i].upper()} {invented(rng, 33, 4000)}", "c") for i in range(6)]
    rows += [(200 + i, f"{invented(rng, 21, 4000)}, {paraphrase(text[i])}. {invented(rng, 50, 4000)}", "c") for i in range(6)]
    rows += [(300, invented(rng, 30000, 4000) + " " + text[3], "c"), (301, text[4], "c"), (301, text[4], "c"), (302, None, "c"), (303, "", "c"), (None, text[5], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, benchmark, rank=32, block_items=8).collect()), key=str)
    want = [(100 + i, i) for i in range(6)] + [(200 + i, i) for i in range(6)] + [(300, 3), (301, 4), (301, 4), (None, 5)]
    assert got == sorted(want, key=str)
    left = decontamination.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.filter("doc_id IS NOT NULL").collect()) == sorted([*range(60), 302, 303])
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.find_leaks(docs.limit(0), benchmark).count() == 0


def test_leaks_of_a_benchmark_larger_than_the_rank(spark):
    """80 passages at rank 16: copies and paraphrases are candidates, also of an item with more passages than the rank."""
    rng = random.Random(12)
    items = [(i, invented(rng, 45, 4000)) for i in range(39)] + [(39, invented(rng, 400, 4000))]
    rows = [(i, invented(rng, 150, 4000)) for i in range(40)]
    rows += [(100 + i, f"{invented(rng, 41, 4000)} {t} {invented(rng, 33, 4000)}") for i, t in items]
    kept = [(i, " ".join(w for j, w in enumerate(t.split()) if j % 7 != 3)) for i, t in items]
    rows += [(200 + i, f"{invented(rng, 30, 4000)} {t} {invented(rng, 35, 4000)}") for i, t in kept]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), rank=16)
    want = [(at + i, i) for at in (100, 200) for i, _ in items]
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want


def test_leak_away_from_the_nearest_window(spark):
    """An item's opening on a stride boundary is nearer than the whole item, or a paraphrase, off the stride far from it."""
    rng = random.Random(13)
    opening = invented(rng, 32, 4000)
    items = [(i, f"{opening} {invented(rng, 28, 4000)}") for i in range(2)] + [(2 + i, invented(rng, 60, 4000)) for i in range(6)]
    rows = [(i, invented(rng, 200, 4000)) for i in range(40)]
    for i, t in items:
        own = t.split()
        quoted = f"{invented(rng, 64, 4000)} {' '.join(own[:32])} {invented(rng, 101, 4000)}"
        rows.append((100 + i, quoted))
        rows.append((200 + i, f"{quoted} {t} {invented(rng, 50, 4000)}"))
        rows.append((300 + i, f"{quoted} {' '.join(w for j, w in enumerate(own) if j % 7 != 3)} {invented(rng, 50, 4000)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(at + i, i) for at in (200, 300) for i, _ in items]
    assert all(r["lcs"] == 1.0 for r in found if r["doc_id"] < 300)


def test_passes_hold_spaces_up_to_their_size(monkeypatch):
    spaces = [decontamination.Space(np.arange(100), np.ones((100, 10)), [0], np.ones((1, 10))) for _ in range(5)]
    monkeypatch.setattr(decontamination, "PASS_MB", 9000 / (1 << 20))
    assert [len(x) for x in decontamination.in_passes(spaces)] == [2, 2, 1]
    monkeypatch.setattr(decontamination, "PASS_MB", 0)
    assert [len(x) for x in decontamination.in_passes(spaces)] == [1] * 5


def plain_leak(item, answer, text, sure=0.75, likely=0.6):
    """Whether some stretch of the text of about the item's length holds the item, by common subsequences of all stretches."""
    n = len(item)
    size = n + n // 4 + 2
    for s in range(0, max(1, len(text) - n // 2)):
        part = text[s:s + size]
        share = decontamination.common_length(item, part) / n
        if share >= sure or (share >= likely and 10 * decontamination.common_length(answer, part) >= 6 * len(answer)):
            return True
    return False


def test_leaks_equal_a_scan_of_all_stretches(spark):
    """Every document against every item; with an answer column that decides between paraphrases."""
    rng = random.Random(21)
    items = [(i, invented(rng, rng.randrange(15, 60), 900), invented(rng, 4, 900) if i % 2 else None) for i in range(24)]
    rows = []
    for i, text, answer in items:
        own = text.split()
        for kind, share in (("whole", 1.0), ("most", 0.85), ("some", 0.66), ("few", 0.3)):
            kept = [w for w in own if rng.random() < share]
            tail = f" {answer}" if answer and kind == "some" and i % 4 == 1 else ""
            rows.append((len(rows), f"{invented(rng, 60, 900)} {' '.join(kept)}{tail} {invented(rng, 60, 900)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string, answer string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    want = {(d, i) for d, t in rows for i, text, answer in items
            if plain_leak(text.split(), (answer or " ".join(text.split()[-5:])).split(), t.split())}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 40
    clear = {(d, i) for d, t in rows for i, text, _ in items if f" {text} " in t}
    assert clear <= got


def test_words_and_buckets_agree():
    texts = ["", " .,- ", "Don't STOP_here 42x", "Größe – “zitiert” … naïve İstanbul", "a—b c’d", "日本語 テスト", "x\u00a0y"]
    for text in texts:
        own = decontamination.words(text)
        assert own == [w for w in re.findall(r"[^\W_]+", text.lower())]
        assert decontamination.buckets(text).tolist() == [int(decontamination.buckets(w)[0]) for w in own]
    rng = random.Random(8)
    long = invented(rng, 30000)
    assert decontamination.buckets(long).tolist() == [int(decontamination.buckets(w)[0]) for w in long.split()]


def test_randomised_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(5)
    dense = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 30))
    rows = spark.createDataFrame([(list(range(30)), x.tolist()) for x in dense], "at array<int>, value array<double>")
    got = decontamination.randomised_svd(rows.repartition(3), 30, 5)
    noisy = dense + 0.01 * rng.normal(size=dense.shape)
    some = spark.createDataFrame([(list(range(30)), x.tolist()) for x in noisy], "at array<int>, value array<double>")
    cut = decontamination.randomised_svd(some, 30, 3, over=2)  # truncated: less than the rows and columns hold
    assert cut.shape == (30, 3)
    top = np.linalg.svd(noisy, full_matrices=False)[2][:3]
    assert np.allclose(cut @ cut.T, top.T @ top, atol=1e-3)
    _, _, want = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(got @ got.T, want[:5].T @ want[:5], atol=1e-6)


def test_common_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(20))] for _ in range(2))
        assert decontamination.common_length(a, b) == plain(a, b)


PAGE = """<html><head><title>t</title><style>p {{}}</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav>
<div class="cookie-banner">We use cookies</div><div class="layout"><article><h1>{title}</h1><p>First &amp; <b>bold</b>
 text {n}.</p><!-- no --><p>Second   paragraph {n} with more words.</p></article><aside>Related</aside></div>
<div id="comments"><p>Nice post {n}</p></div><form><p>Sign up</p></form><script>var x = "<p>no</p>";</script><footer>Imprint</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(title=f"Title {i}", n=i), "x") for i in range(20)]
    rows += [(100, "https://a.example/e", None, "x"), (101, None, "", "x"), (102, None, PAGE.format(title="Alone", n=7), "x"),
             (103, "no url", "<p>cut off", "x"), (0, rows[0][1], rows[0][2], "x"), (104, "https://b.example/l", PAGE.format(title="L", n="word " * 20000), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.extract(pages)
    assert sorted(found.columns) == ["page_id", "text", "url"]
    got = [(r["page_id"], r["text"]) for r in found.collect()]

    def want(title, n):
        return f"{title}\n\nFirst & bold text {n}.\n\nSecond paragraph {n} with more words."

    expected = [(i, want(f"Title {i}", i)) for i in range(20)] + [(0, want("Title 0", 0)), (100, ""), (101, ""), (102, want("Alone", 7)), (103, "cut off")]
    expected.append((104, want("L", ("word " * 20000).strip()).replace("word.", "word .").replace("word with", "word with")))
    assert sorted(got) == sorted(expected)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_outside_slot_leaves_its_path(spark):
    """Hidden or marked elements go alone: plain ones of the same path stay, on their page and all others of the host."""
    marked = ["<p hidden>no</p>", "<p style='display:none'>no</p>", "<p role='alert'>no</p>", "<p id='ad-3'>no</p>", "<p aria-hidden='true'>no</p>"]
    rows = [(i, f"https://a.example/{i}", f"<body><article><h1>T {i}</h1><p>Text {i}.</p>{marked[i] if i < 5 else ''}<p>More {i}.</p></article></body>") for i in range(12)]
    rows.append((50, None, f"<body><article><p>Text.</p>{''.join(marked)}</article></body>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T {i}\n\nText {i}.\n\nMore {i}." for i in range(12)} | {50: "Text."}


def test_html_constant_slots(spark):
    """Constant texts stay under article and on few or copied pages; elsewhere one on most distinct pages goes."""
    rows = [(i, f"https://a.example/{i}", f"<body><article><h2>Summary</h2><p>Text {i}.</p></article></body>") for i in range(8)]
    plain = "<body><div class='text'><p>Text {0} with many words in it.</p>{1}</div></body>"
    rows += [(20 + i, f"https://b.example/{i}", plain.format(i, "<h4>Our motto</h4>")) for i in range(8)]
    rows += [(40 + i, f"https://c.example/{i}", plain.format(i, "")) for i in range(4)]
    rows += [(50 + i, f"https://c.example/c{i}", plain.format("copied", "<pre>code</pre>")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Summary\n\nText {i}." for i in range(8)}
    want |= {at + i: f"Text {i} with many words in it." for at, n in ((20, 8), (40, 4)) for i in range(n)}
    assert got == want | {50 + i: "Text copied with many words in it.\n\ncode" for i in range(9)}


def read_pages(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(frame.repartition(3)).collect()}


def body_text(rng, n=3):
    return [" ".join(invented(rng, 30).split()) + "." for _ in range(n)]


@pytest.mark.parametrize("around", [
    '<body class="post no-sidebar">{}</body>', '<body class="menu-open"><div id="skip-link-target">{}</div></body>', '<div class="search"><div>{}</div></div>',
    '<body id="comments">{}</body>'])
def test_html_words_around_the_article_do_not_hide_it(spark, around):
    rng = random.Random(30)
    paras = body_text(rng)
    inner = ('<h2 id="share-price-history">Prices</h2>' + "".join(f"<p>{p}</p>" for p in paras)
             + '<p class="search-results">Found</p><div class="form-group">Kept</div><div class="comments">Nice</div><ul class="share-buttons"><li>Tweet</li></ul>')
    got = read_pages(spark, [(1, "http://a.b/1", around.format(f"<nav>Home</nav><article>{inner}</article><footer>Imprint</footer>"))])
    assert got[1].split("\n\n") == ["Prices", *paras, "Found", "Kept"]


def test_html_cards_in_main_and_a_list_of_articles(spark):
    rng = random.Random(31)
    paras = body_text(rng)
    page = "<header>Site</header><main><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "<article><h3>Card</h3></article><aside>More</aside></main>"
    many = "<div><article><p>One</p></article><article><p>Two</p></article></div><div class='comments'><article class='comment'><p>No</p></article></div>"
    got = read_pages(spark, [(1, "http://a.b/1", page), (2, "http://a.b/2", many), (3, "http://a.b/3", "<div role='main'><p>Here</p></div><p>Not</p>")])
    assert got[1].split("\n\n") == ["Title", *paras, "Card"]
    assert got[2].split("\n\n") == ["One", "Two"] and got[3] == "Here"


def test_html_two_templates_on_one_host(spark):
    """Pages with article and pages without it; the latter by the wrapper, also where units are missing or repeated."""
    rng = random.Random(32)
    rows, want = [], {}
    for i in range(40):
        paras = body_text(rng, rng.randrange(2, 6))
        if i % 2:
            html = f"<nav>Home</nav><article>{''.join(f'<p>{p}</p>' for p in paras)}</article>"
        else:
            quote = "<blockquote>" + paras[1] + "</blockquote>" if i % 4 else f"<p>{paras[1]}</p>"
            blurb = f"<div><p>See also {invented(rng, 3)}</p></div>" if i % 3 else ""
            html = ("<body><div><p>Our site about everything</p></div><div class='ad-slot'>Buy</div><h1 class='x'></h1>" + f"<section>{i}</section>" * (i % 5 == 0)
                    + f"<div><p>{paras[0]}</p>{quote}{''.join(f'<p>{p}</p>' for p in paras[2:])}</div><hr><section><p>Tags</p></section>{blurb}<div><p>All rights reserved by us</p></div></body>")
        rows.append((i, f"https://u@Host.example:80/{i}", html))
        want[i] = paras
    rows.append((100, "https://host.example/100", rows[1][2]))
    got = read_pages(spark, rows)
    for i, paras in want.items():
        assert got[i].split("\n\n")[:len(paras)] == paras if i % 2 else all(p in got[i] for p in paras), (i, got[i])
        assert "Home" not in got[i] and "Buy" not in got[i] and "All rights" not in got[i] and "Our site" not in got[i]
        if not i % 2:
            assert "See also" not in got[i] and "Tags" not in got[i]
    assert got[100] == got[1]


def test_html_constant_texts(spark):
    rng = random.Random(33)
    rows, want = [], {}
    for i in range(12):
        paras = body_text(rng)
        rows.append((i, f"http://c.d/{i}", f"<article><h2>Summary</h2>{''.join(f'<p>{p}</p>' for p in paras)}</article>"))
        rows.append((50 + i, f"http://e.f/{i}", f"<div><p>Welcome to our pages</p>{''.join(f'<p>{p}</p>' for p in paras)}</div>"))
        want[i], want[50 + i] = ["Summary", *paras], paras
    # three copies of one page are no evidence that its texts are constant
    rows += [(90 + i, f"http://g.h/{i}", "<div><p>One and only text of this host</p></div>") for i in range(3)]
    got = read_pages(spark, rows)
    assert {i: t.split("\n\n") for i, t in got.items() if i < 90} == want
    assert {got[90 + i] for i in range(3)} == {"One and only text of this host"}


def test_html_many_shapes_of_a_host_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP", 4)
    rng = random.Random(34)
    rows, want = [], {}
    for i in range(60):
        paras = body_text(rng, 2)
        extra = "".join(f"<section class='s{chr(97 + k)}'>x{rng.random()}</section>" for k in range(8) if rng.random() < 0.5)
        rows.append((i, f"http://t.u/{i}", f"{extra}<div class='text'>{''.join(f'<p>{p}</p>' for p in paras)}</div>"))
        want[i] = "\n\n".join(paras)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers = html_extract.infer_wrappers(frame).collect()
    assert len(wrappers) == 1
    keys = [u.key for u in html_extract.unpacked(wrappers[0]["wrapper"])]
    assert keys.count("div.text") == 1 and len(keys) <= 9 * 3
    assert read_pages(spark, rows) == want


def test_html_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "text" + "</div>" * 5000
    got = read_pages(spark, [(1, None, deep), (2, "no host", "<p>a<p>b<div>c"), (3, None, None), (4, "http://x.y/", "<!-- <p>x"), (5, "http://x.y/", "plain &amp; simple")])
    assert got == {1: "text", 2: "a\n\nb\n\nc", 3: "", 4: "", 5: "plain & simple"}


def test_align_is_union_free():
    unit = html_extract.Unit

    def expr(*keys):
        return [unit(k, False, False, hash(k), 1, 1) for k in keys]

    got = html_extract.align(expr("h", "p", "p"), expr("h", "n", "p"))
    assert [(u.key, u.optional, u.pages) for u in got] in (
        [("h", False, 2), ("n", True, 1), ("p", False, 2), ("p", True, 1)], [("h", False, 2), ("p", True, 1), ("n", True, 1), ("p", False, 2)],
        [("h", False, 2), ("n", True, 1), ("p", True, 1), ("p", False, 2)])
    same = [unit("d", False, False, 1, 5, 1), unit("d", True, False, 2, 50, 1)]
    other = [unit("d", False, False, 1, 5, 1), unit("d", False, False, 3, 60, 1)]
    assert [(u.text, u.worth, u.repeated) for u in html_extract.align(same, other)] == [(1, 10, False), (None, 110, True)]


def test_pipeline_stages(spark, sf_dir):
    """Every stage on what its predecessor kept, against plain Python where the stage has a plain form."""
    import corpus_pipeline

    from tests.llm.test_line_search import plain_dedup

    from loadline.plans.staging import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    frame = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        frame = stage(step(spark, frame, sf_dir), f"test-{name}")
        assert frame.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in frame.collect()}
    clean = kept["toxicity"]
    assert clean and all(clean[i] == before[i] for i in clean)
    lines = {i: text for i, text, _, _ in plain_dedup([(i, r["text"]) for i, r in clean.items()])}
    assert {i: r["text"] for i, r in kept["line_dedup"].items()} == lines
    comps = plain_components(sorted(lines.items()), 5, 80, 100)
    assert set(kept["ngram_join"]) == {i for i, (_, c) in comps.items() if i == c}
    items = [decontamination.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = [" " + " ".join(x) + " " for x in items if x]
    for i, r in kept["ngram_join"].items():
        own = " " + " ".join(decontamination.words(r["text"])) + " "
        assert not any(x in own for x in items) or i not in kept["decontamination"]
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert {r["doc_id"] for r in last} == set(kept["decontamination"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))
