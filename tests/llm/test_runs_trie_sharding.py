"""Periodic runs, the conversation trie and sharding against plain versions and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import docs_df, words
from pyspark.sql import functions as F

from fleetlog.llm import conversation_trie, periodic_runs, queries, sharding

TURNS = "conv_id long, turn long, role string, text string"


# --- 11 -----------------------------------------------------------------------


def plain_runs(ws, min_length=6, min_periods=4):
    shortest = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            s = i
            while i + q < len(ws) and ws[i] == ws[i + q]:
                i += 1
            if i - s >= q:
                shortest.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in shortest.items() if e - s >= max(min_length, min_periods * q))


def repetitive(rnd):
    k, n = rnd.choice([1, 2, 3, 6]), rnd.randint(0, 70)
    ws = [rnd.randrange(k) for _ in range(n)]
    if n > 3 and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 3))
        ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
    return ws


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2)])
def test_runs_of_many_texts_at_once(bounds):
    rnd = random.Random(3)
    for _ in range(150):
        texts = [repetitive(rnd) for _ in range(rnd.randint(1, 6))]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = periodic_runs.runs_of(np.array([w for t in texts for w in t], np.int64), offsets, *bounds)
        got = defaultdict(list)
        for row, *run in zip(*(x.tolist() for x in found)):
            got[row].append(tuple(run))
        assert [got[i] for i in range(len(texts))] == [plain_runs(t, *bounds) for t in texts]


def test_runs_in_chunks_and_of_long_texts(monkeypatch):
    rnd = random.Random(5)
    text = [rnd.randrange(2) for _ in range(400)] + [0, 1, 1] * 60 + [2] * 90
    monkeypatch.setattr(periodic_runs, "CHUNK", 7)
    monkeypatch.setattr(periodic_runs, "STEPS", 2)
    found = periodic_runs.runs_of(np.array(text), np.array([0, len(text)]))
    assert list(zip(*(x.tolist() for x in found[1:]))) == plain_runs(text)
    for period in (1, 3):
        row, start, length, q = periodic_runs.runs_of(np.arange(60_000) % period, np.array([0, 60_000]))
        assert (start.tolist(), length.tolist(), q.tolist()) == ([0], [60_000], [period])


def test_periodic_query_equals_plain_version(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join("ab cd é f".split()[w % 4] for w in repetitive(rnd)) for _ in range(150)]
    texts += [None, "", "  \n ", "x " * 500, "a b\tc\nd\x0ba\x0cb\rc d", " ".join(str(i) for i in range(30)), texts[3]]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, texts[3]), (9, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for doc, text in rows:
        ws, h = words(text), zlib.crc32(str(doc).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(ws)
        kept = [w for i, w in enumerate(ws) if not any(s + q <= i < s + size for s, size, q in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        text_of = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want[(doc, len(runs), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (text_of, " ".join(kept))))] += 1
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)


def test_runs_of_no_rows(spark):
    found = periodic_runs.periodic_runs(docs_df(spark, []))
    assert found.count() == 0 and found.columns[-3:] == ["n_runs", "runs", "collapsed"]


# --- 12 -----------------------------------------------------------------------


def plain_trie(sequences):
    """``{conv_id: ((digest or text, words), ...)}`` to the rows of the trie."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(of) - 1) * (p[-1][1] if p else 0)
    return Counter(
        (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, of in members.items()
    )


def conversations(rnd, n):
    out = {}
    for c in rnd.sample(range(10 * n), n):
        kind = rnd.random()
        if kind < 0.3:
            turns = [0, 0, 1, 1]
        elif kind < 0.6:
            turns = [0] * rnd.randint(0, 9)
        else:
            turns = [rnd.randrange(3) for _ in range(rnd.randint(0, 6))]
        out[c] = tuple((hashlib.sha256(bytes([t])).hexdigest()[:32], t + 1) for t in turns)
    return out


@pytest.mark.parametrize("block_turns, partitions", [(1 << 18, 1), (1, 3), (6, 5), (40, 4)])
def test_trie_over_block_edges(spark, block_turns, partitions):
    own = conversations(random.Random(block_turns), 130)
    schema = "conv_id long, turns array<struct<digest:string,words:long>>"
    df = spark.createDataFrame(list(own.items()), schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = conversation_trie.trie(df, block_turns).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert Counter(tuple(r) for r in got) == plain_trie(own)


def test_extents_are_found_from_any_member():
    own = sorted((b"".join(bytes.fromhex(t[0]) for t in turns), c, turns) for c, turns in conversations(random.Random(1), 90).items())
    block = conversation_trie.Block(np.array([c for _, c, _ in own]), [p for p, _, _ in own], [np.array([w for _, w in t], np.int64) for _, _, t in own], -1, -1)
    for k, (_, _, turns) in enumerate(own):
        for d in range(len(turns) + 1):
            same = [i for i, (_, _, other) in enumerate(own) if other[:d] == turns[:d]]
            left, right = block.extents(np.array([k]), np.array([d]))
            assert (left[0], right[0]) == (same[0], same[-1]) and block.smallest(left, right)[0] == min(own[i][1] for i in same)


def test_trie_query_rebuilds_conversations(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for c in [*range(0, 90, 1), 400, 401, 1000]:
        if c == 40:  # an absent opening conversation
            continue
        for t in range(rnd.randint(1, 5)):
            rows.append((c, None if rnd.random() < 0.1 else t, rnd.choice(["user", None, ""]), rnd.choice(["a  b", "c", None, "", "x\ty\nz é"])))
    rows = list(dict.fromkeys((c, t, "", "") if t is None else (c, t, r, x) for c, t, r, x in rows))  # no ties but equal rows
    rows += [(20, 9, "user", "same"), (20, 9, "user", "same"), (None, 1, "user", "nobody")]
    spark.createDataFrame(rows, TURNS).withColumn("path", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            turns[c].append(((r or "", x or ""), len(words(x))))
    own = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        own[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    got = queries.op12_conversation_trie(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == plain_trie(own)
    assert any(not s for s in own.values())


def test_trie_of_no_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.trie(queries.rebuilt_conversations(empty)).count() == 0


# --- 13 -----------------------------------------------------------------------


def source_rows(n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["hot"] * 5 + ["a", "b", "c", None, f"own{i}"])) for i in range(n)]
    return rows + [(None, "a"), (None, "b"), (3, "hot"), (3, "hot")]


@pytest.mark.parametrize("n, shards", [(900, 24), (10, 24), (333, 7), (50, 1)])
def test_shards_hold_the_mixture_in_equal_counts(spark, n, shards):
    rows = source_rows(n)
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("x")).withColumn("_shard_rank", F.lit(1))
    got = sharding.interleaved(df, shards).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in of) == list(range(len(of))) for of in by_shard.values())
    share = Counter(s for _, s in rows)
    for s in range(shards):
        held = Counter(r.source for r in by_shard[s])
        for source, many in share.items():
            # a stretch of the order holds a source within one row; so do the cuts at both ends
            assert abs(held[source] - Fraction(many * sizes[s], len(rows))) <= 1 + len(share) * 2 / 3


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(source_rows(400), "doc_id long, source string")
    a, b = (Counter(map(tuple, sharding.interleaved(x, 5).collect())) for x in (df, df.orderBy("source").repartition(7)))
    assert a == b
    other = Counter(map(tuple, sharding.interleaved(df, 5, seed=1).collect()))
    assert other != a


def test_no_rows_and_written_shards(spark, tmp_path):
    df = spark.createDataFrame(source_rows(60), "doc_id long, source string")
    assert sharding.interleaved(df.limit(0), 3).count() == 0
    sharding.written(df, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 64 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_sharding_query_holds_every_document(spark):
    got = queries.op13_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts.items()}
    sizes = Counter(r.shard for r in got)
    assert len(got) == 200 and len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in got} == {"rows"}
