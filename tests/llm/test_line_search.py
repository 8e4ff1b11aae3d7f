"""Line dedup, vector search, chat windows, sharding against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loadline.llm import chat, line_dedup, pivot_search, sharding
from loadline.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, n_lines string"


def docs_frame(spark):
    """Nulls, empty and long texts, ties, repeated rows, a clashing column."""
    a, b = "A Line that is Long Enough here", "another line that is long enough"
    rows = [(1, f"{a}\nx\n  {a.lower()}\t", "en", "q"), (2, f"{a}\n{b}", None, "q"), (3, f"{b}\r\n{a.upper()}", "en", None),
            (3, f"{b}\r\n{a.upper()}", "en", None), (4, None, "en", "q"), (5, "", "en", "q"), (6, b + "\n" + "word " * 30000, "en", "q"),
            (None, f"{a}\n{b}", "en", "q"), (7, "short\nshort", "en", "q"), (8, "short", "en", "q"), (9, "short", "en", "q")]
    return spark.createDataFrame(rows, DOC)


def plain_dedup(rows, min_docs=3, min_chars=20):
    space, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(x):
        return x.strip(space).translate(lower)

    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    drop = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or drop.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def collected(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


def test_line_dedup_edges(spark):
    docs = docs_frame(spark)
    got = line_dedup.dedup_lines(docs, shards=4)
    assert sorted(got.columns) == ["doc_id", "lang", "n_dropped", "n_lines", "text"]
    assert collected(got) == sorted(plain_dedup([(r[0], r[1]) for r in docs.collect()]), key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_is_reversible(spark):
    docs = docs_frame(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    first, more = docs.filter("doc_id < 4"), docs.filter("doc_id >= 4")
    state = line_dedup.insert(line_dedup.empty_state(spark, shards=3), first)
    both = line_dedup.insert(line_dedup.insert(state, more), more)
    assert collected(line_dedup.dedup(docs, both)) == sorted(plain_dedup([(r[0], r[1]) for r in docs.collect()]), key=str)
    back = line_dedup.delete(both, more.select("doc_id"))
    for name in ("refs", "pairs"):
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(state, name).collect()))
    fewer = line_dedup.delete(both, docs.filter("doc_id = 1").select("doc_id"))
    left = docs.filter("doc_id <> 1")
    assert collected(line_dedup.dedup(left, fewer)) == sorted(plain_dedup([(r[0], r[1]) for r in left.collect()]), key=str)


def test_cuckoo_filter_forgets():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    held = line_dedup.Cuckoo.sized(5000)
    assert held.insert(keys) and held.has(keys).all()
    held.delete(keys[:2500])
    assert held.has(keys[2500:]).all() and held.has(keys[:2500]).mean() < 0.01
    assert line_dedup.Cuckoo.load(held.dump()).has(keys[2500:]).all()


@pytest.mark.parametrize("task_rows,task_queries", [(50_000, 20_000), (20, 7)])
def test_search_is_exact(spark, task_rows, task_queries):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6)) * 100
    rows = [(i, [float(np.floor(x)) for x in centres[i % 5] + rng.normal(size=6) * 10], "x") for i in range(300)]
    rows += [(300 + i, rows[0][1], "tie") for i in range(8)]
    rows += [(400, None, ""), (401, [1.0, None], ""), (402, [float("nan")], ""), (403, [float("inf")], ""), (404, [5.0], "short"), (405, [], "empty")]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, rank string")
    got = pivot_search.search(df, df.filter("vec_id % 10 = 0"), k=5, pivots=4, rings=3, sample=100, task_rows=task_rows, task_queries=task_queries)
    good = {i: np.pad(v, (0, 6 - len(v))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 10 == 0:
            best = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    assert pivot_search.search(df.limit(0), df.limit(0)).count() == 0


def test_chat_windows_round_trip(spark):
    random.seed(2)
    hard = ["\\### Assistant: </turn> ok", "\\l\\b<turn role=user>\n", "", None, "a " * 900, "plain text", "\\", "</turn>\n"]
    rows = [(c, t, random.choice(["user", "assistant"]) if t else "system", random.choice(hard)) for c in range(6) for t in range(25)]
    rows += [(7, 0, "user", "x"), (7, 0, "user", "x"), (7, None, None, "null turn"), (None, 1, "assistant", "no id"), (8, 0, "system", "s " * 3000), (8, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash"))
    windows = chat.format_windows(df, budget=256, history=64).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss"] == "".join(x for role, x in turns if role == "assistant")
    def plain(part):
        role, _, text = part.removeprefix("<turn role=").partition(">\n")
        for sign, code in reversed(chat.ESCAPES):
            role, text = role.replace(code, sign), text.replace(code, sign)
        return role, text

    def size(turn):
        return len(regex.findall(chat.TOKEN, turn[1])) + chat.MARKUP

    first = {}
    for w in sorted(windows.collect(), key=lambda w: (str(w["conv_id"]), w["stride_no"], w["alone"])):
        turns = [plain(x) for x in w["formatted"].split(chat.END)[:-1]]
        repeated, new = turns[:w["n_repeat"]], turns[w["n_repeat"]:]
        has_system = first.setdefault(w["conv_id"], turns[0])[0] == "system"
        system = size(first[w["conv_id"]]) if has_system else 0
        assert w["tokens"] == sum(map(size, turns)) and new
        if repeated and has_system:
            assert repeated[0] == first[w["conv_id"]]
        assert sum(map(size, repeated[has_system:] if repeated else [])) <= 64  # the history
        stride = max(256 - 64 - system, 64)
        own = [t for t in new if not (has_system and t is turns[0])]
        assert len(own) <= 1 or sum(map(size, own)) <= stride
        assert w["tokens"] <= 256 or len(own) <= 1 or system > 128
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_shards_balance(spark):
    random.seed(3)
    rows = [(i, "t" * random.randint(1, 500) + str(i % 400), "c") for i in range(900)] + [(1000, None, "c"), (1001, "", "c"), (1001, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for block in (20_000, 30):
        got = sharding.shard_by_bytes(df, shards=7, block_groups=block).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
        text = {r[0]: r[1] for r in rows}
        sums, slots, where = {}, {}, {}
        for r in got:
            assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 16
            sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert where.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len(sums) == 7 and max(sums.values()) - min(sums.values()) < 40
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_chat_query_digests(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()
    said = "\\### Assistant: </turn> ok"
    rows += [dict(conv_id=-7, turn=0, role="user", text=said), dict(conv_id=-7, turn=1, role="assistant", text=said)]
    want = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        x = want.setdefault(r["conv_id"], ["", "", 0])
        x[0] += f"{r['role']}\n{r['text'] or ''}\n"
        x[1] += (r["text"] or "") if r["role"] == "assistant" else ""
        x[2] += 1
    got = {r["conv_id"]: r for r in QUERIES["op4_chat_windows"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for c, (turns, loss, n) in want.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            n, hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_sharding_query(spark, sf_dir):
    import pyarrow.parquet as pq

    text = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = QUERIES["op10_differencing_shards"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text.items()}
    assert len(got) == len(text)
