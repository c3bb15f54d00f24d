"""Top-k, joins, deduplication and packing against plain versions and edge cases."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import docs_df, near_components, prose, without_windows, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlog.llm import components, line_dedup, ngram_join, packing, substring_dedup, topk

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


# --- 3 ------------------------------------------------------------------------


def nearest(vectors, k):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(1024 * np.float64(np.float32(x)))) for x in v])
    want = set()
    for q in (i for i in usable if i % 5 == 0):
        own = min(usable[q], key=lambda v: np.array(v, "<i8").tobytes())
        found = sorted((-sum(x * y for x, y in zip(own, v)), i) for i, vs in usable.items() if i != q for v in vs)[:k]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)}
    return want


@pytest.mark.parametrize("candidate_block, query_block", [(8_192, 1_024), (7, 2)])
def test_top_k_equals_all_scores(spark, candidate_block, query_block):
    rnd = random.Random(4)
    vectors = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.random()]) for _ in range(6)]) for i in range(60)]
    vectors += [(100, None), (105, [1.0, None] * 3), (110, [float("nan")] * 6), (115, [float("inf")] * 6), (None, [1.0] * 6),
                (120, [0.0] * 6), (121, vectors[3][1]), (122, vectors[3][1]), (7, vectors[7][1]), (125, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS).withColumnRenamed("label", "vector")
    got = topk.top_k(topk.integer_vectors(df), "vec_id % 5 = 0", 4, candidate_block, query_block)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == nearest(vectors, 4)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (5, [2.0], 0), (6, [3.0], 0)], VECTORS)
    got = topk.top_k(topk.integer_vectors(df), "vec_id % 5 = 0", 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 6), (0, 2, 5), (5, 1, 6), (5, 2, 0)]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), "vec_id % 5 = 0", 10).count() == 0


def test_vectors_too_long_for_exact_scores_are_named(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (77, [1e17], 0)], VECTORS)
    with pytest.raises(Exception, match="vector 77"):
        topk.integer_vectors(df).collect()


def test_pivot_bounds_eliminate_without_losing(spark):
    rnd = np.random.default_rng(1)
    rows = np.round(rnd.normal(size=(3000, 4)) * 300) + (np.arange(3000) % 2 * 4000)[:, None]
    ids = np.arange(3000)
    pivots = topk.choose_pivots(rows[:200], 16)
    far = topk._distances(rows, pivots).astype(np.float32)
    starts = [topk.start_score(q, rows[q], ids[:200], rows[:200], 5) for q in range(3)]
    got = topk.search_block(ids[:3], rows[:3], far[:3], starts, ids, rows, far, 5)
    for q in range(3):
        scores = rows @ rows[q]
        scores[q] = -np.inf
        want = sorted(zip(-scores, ids))[:5]
        assert [(i, s) for a, i, s in got if a == q][:5] == [(i, int(-s)) for s, i in want]


def test_clusters_beyond_the_start_are_skipped(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=4) * 0.1 + (5 if i % 2 else -5)], 0) for i in range(600)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, VECTORS))
    matrix = topk._matrix([r.vector for r in vectors.orderBy("vec_id").collect()], 4)
    pivots = topk.choose_pivots(matrix[:100], 8)
    clusters = topk._clusters(topk.pivot_table(vectors, pivots), len(pivots), 4)
    far, ids = topk._distances(matrix, pivots), np.arange(600)
    assert sum(n for n, *_ in clusters.values()) == 600
    skipped = 0
    for q in range(0, 600, 37):
        start = topk.start_score(q, matrix[q], ids[:100], matrix[:100], 5)
        opened = topk.open_clusters(matrix[q] @ matrix[q], far[q], start, clusters)
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        best = np.argsort(-scores)[:5]
        assert set(far[best].argmin(axis=1)) <= set(opened)
        skipped += len(clusters) - len(opened)
    assert skipped >= 17
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, "vec_id % 5 = 0", 4, 50, 20).collect()} == nearest([r[:2] for r in rows], 4)


# --- 5 ------------------------------------------------------------------------

BOILER = "All rights reserved by the people of this page."
SITES = "doc_id long, text string, lang string, source string, n_chars int"


def site_docs(spark):
    rnd = random.Random(6)
    rows = [(i, f"{prose(rnd, 6)}\n {BOILER}\t\r\n{prose(rnd, 5)} tail {i}", "en", f"s{i % 12}", 0) for i in range(40)]
    rows += [(100 + i, f"nine sites have this line\nshort\n{i} own words of document {i}", "en", f"s{i}", 0) for i in range(9)]
    rows += [(200, None, "en", "s1", 0), (201, "", "en", None, 0), (None, BOILER, "en", "s2", 0), (202, "short", "en", None, 0), (39, rows[39][1], "en", "s3", 0)]
    rows += [(300 + i, "short\nshort", "en", f"s{i % 12}", 0) for i in range(12)]
    return rows


def test_line_dedup_equals_the_plain_version(spark):
    rows = site_docs(spark)
    sites, home = defaultdict(set), {}
    for doc_id, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r")
            if len(line) >= 20:
                sites[line] |= {source} - {None}
                home[line] = min((i for i in (home.get(line), doc_id) if i is not None), default=None)
    want = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        away = [len(sites.get(x.strip(" \t\r"), ())) >= 10 and home[x.strip(" \t\r")] != doc_id for x in lines]
        kept = None if text is None else "\n".join(x for x, a in zip(lines, away) if not a)
        want.append((doc_id, 0 if text is None else len(lines), sum(away) if text is not None else 0, kept))
    df = spark.createDataFrame(rows, SITES).withColumnRenamed("n_chars", "_key").withColumn("n_lines", F.lit("own"))
    out = line_dedup.without_boilerplate(df)
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(g[2] for g in got) > 35
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0


def test_long_documents_of_many_boilerplate_lines(spark):
    lines = [f"this is boilerplate line number {i}" for i in range(20_000)]
    rows = [(i, "\n".join(lines + [f"and one of document {i} alone"]), "en", f"s{i}", 0) for i in range(12)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, SITES)).collect()}
    assert got[0] == (20_001, 0, rows[0][1])
    assert all(got[i] == (20_001, 20_000, f"and one of document {i} alone") for i in range(1, 12))


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(100 * n + i, f"a line that stands on {n} sites", "en", f"s{i}", 0) for n in range(7, 14) for i in range(n)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, SITES), 20, "doc_id", "text", "source")
    assert line_dedup.boilerplate(lines, 10).count() == 4  # 10 to 13 sites


# --- 7 ------------------------------------------------------------------------


def passages(seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    shared = [prose(rnd, n, 10_000).split() for n in (34, 35, 36, 60, 200)]
    texts: list[str | None] = [None, "", "one two", "\n".join(shared[4]), " ".join(shared[4])]
    for i in range(40):
        own = prose(rnd, rnd.randrange(3, 90), 10_000).split()
        at = rnd.randrange(len(own))
        own[at:at] = shared[i % 5] if i % 3 else []
        texts.append(" ".join(own))
    texts += ["la " * 90, "tick tock " * 50, " ".join(f"u{i}" for i in range(70)), "Z" * 5000]
    return texts


def test_substring_dedup_equals_the_plain_version(spark, tmp_path):
    texts = passages(8)
    df = docs_df(spark, [*enumerate(texts), (3, texts[6])]).withColumn("n_words", F.lit(1)).withColumnRenamed("lang", "_slice")
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    ids = [*range(len(texts)), 3]
    want = sorted((i, n, gone, " ".join(kept)) for i, (n, gone, kept) in zip(ids, without_windows([*texts, texts[6]])))
    got = substring_dedup.without_repeats(df, joined=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in got) == want
    assert sum(w[2] for w in want) > 500


def test_substring_dedup_leaves_other_texts_as_they_are(spark, tmp_path):
    docs_df(spark, [None, "a  b\n\nc", ""]).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    assert {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()} == {0: None, 1: "a  b\n\nc", 2: ""}
    assert substring_dedup.without_repeats(df.limit(0)).count() == 0


def test_substring_dedup_of_texts_beyond_one_arrow_batch(spark, tmp_path):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(950)) for _ in range(2200)]  # about 10 KB each
    for i in (3, 1675, 1677, 2199):
        texts[i] += " " + passage
    df = docs_df(spark, texts).withColumn("source", F.lit("s" * 40)).coalesce(1)
    df.write.parquet(str(tmp_path / "docs"))
    got = substring_dedup.without_repeats(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "n_words", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == dict.fromkeys((3, 1675, 1677, 2199), 40)
    assert len(got) == 2200 and sum(r.n_words for r in got) == 2200 * 950 + 160


def test_second_hash_tells_windows_apart(monkeypatch):
    """With a first hash that is the same for all words, the second one still has a value of its
    own for each different window."""
    texts = passages(9)
    plain = substring_dedup.hash_words
    monkeypatch.setattr(substring_dedup, "hash_words", lambda words, seed=0: plain(words, seed) if seed else np.full(len(words), 7, np.uint64))
    found = substring_dedup.words_of(pa.array([t or "" for t in texts], pa.large_string()))
    assert len(set(substring_dedup._windows(found, 35)[0])) == 1
    second = substring_dedup._windows(found, 35, substring_dedup.SECOND)[0]
    split = [t.split() for t in texts if t]
    assert len(set(second)) == len({tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34)})


def test_sketch_blocks_pack_and_answer():
    layout = substring_dedup.Layout(10_000)
    rnd = np.random.default_rng(5)
    hashes = rnd.integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2)
    cells = substring_dedup._upto_two(layout.cells(np.concatenate([hashes, hashes[:50], hashes[:50]])))
    edges = layout.cut(cells, layout.cell_bits)
    for a, b in zip(edges, edges[1:]):
        low = np.uint64((1 << (layout.cell_bits - layout.block_bits)) - 1)
        assert (layout.unpack(layout.pack(cells[a:b])) == cells[a:b] & low).all()
    x, y = substring_dedup._answer([np.array([1, 2, 2], np.uint64), np.array([3, 1], np.uint64)])
    assert x.tolist() == [True, True, True] and y.tolist() == [False, True]


# --- 2 ------------------------------------------------------------------------


def families(seed: int, many: int = 6) -> list[tuple[int, str | None]]:
    """Originals, exact copies, near copies by a few words, chains and odd texts."""
    rnd, rows = random.Random(seed), [(0, None), (1, ""), (2, " \t"), (3, "two words"), (4, "TWO  Words"), (5, "Two wordS x")]
    for _ in range(8):
        text = prose(rnd, rnd.randrange(5, 200), 3000).split()
        for _ in range(many):
            kind = rnd.randrange(4)
            if kind == 1:
                for _ in range(max(1, len(text) // 60)):
                    text[rnd.randrange(len(text))] = f"new{rnd.randrange(9999)}"
            copy = text + ["tail"] * (kind == 2) + [f"x{rnd.randrange(99)}"] * (kind == 3) * rnd.randrange(1, 12)
            rows.append((len(rows) * 3 % 997 + 10, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed, bucket, hot", [(1, 256, 1 << 18), (2, 1, 1 << 18), (3, 3, 1 << 18), (4, 256, 1), (6, 1, 2)])
def test_near_duplicates_equal_all_pairs(spark, seed, bucket, hot):
    rows = families(seed)
    df = docs_df(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "sid")
    got = ngram_join.near_duplicates(df, bucket=bucket, hot=hot).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(rows)


def test_long_texts_links_at_the_threshold_and_repeated_rows(spark):
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(6_000)]
    other = base[:]
    for i in range(40, 6_000, 160):
        other[i] = f"n{rnd.random()}"
    # 14 shared of 18 shingles, then 15 of 20: above and exactly at three quarters; 14 of 19 below
    line = [f"q{i}" for i in range(18)]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (10, " ".join(line + ["a", "b", "c", "d"])), (11, " ".join(line)),
            (20, " ".join(f"r{i}" for i in range(20))), (20, " ".join(f"r{i}" for i in range(20))), (21, " ".join(f"r{i}" for i in range(22)))]
    got = ngram_join.near_duplicates(docs_df(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(rows)


def test_one_of_each_component_stays(spark):
    rows = families(5)
    rows += [(rows[6][0], rows[6][1]), (None, rows[6][1]), (None, "a text that nobody else has at all")]
    smallest = {c for i, n, c in near_components([r for r in rows if r[0] is not None]) if n}
    kept = ngram_join.one_of_each(docs_df(spark, rows).withColumnRenamed("lang", "_key")).collect()
    assert sorted(r.doc_id for r in kept if words(r.text) and r.doc_id is not None) == sorted(smallest)
    assert [r.text for r in kept if r.doc_id is None] == ["a text that nobody else has at all"]
    assert sum(not words(r.text) for r in kept) == 3
    assert ngram_join.one_of_each(docs_df(spark, [])).count() == 0


def test_strays_meet_a_bounded_number_of_the_main_component(spark):
    held = [(token, sid, 100, sid % 5, 1 if sid < 400 else sid) for token in (7, 8) for sid in range(440)]
    df = spark.createDataFrame(held, "token long, sid long, n long, at long, label long")
    pairs = [(r.a, r.b) for r in ngram_join.stray_pairs(df, 75).collect()]
    assert {a for a, _ in pairs} == set(range(400, 440)) and all(b < 400 for _, b in pairs)
    assert len(pairs) <= 2 * 40 * ngram_join.STRAY_CELLS
    # drawn anew for each token: a set meets others by its second one
    assert all(len({b for a, b in pairs if a == stray}) > ngram_join.STRAY_CELLS for stray in range(400, 440))


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    up = {n: n for pair in links for n in pair}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    assert {r.node: r.label for r in components.connected(df).collect()} == up
    assert components.connected(df.limit(0)).count() == 0


def test_size_estimates_of_components_do_not_grow_with_the_rounds(spark):
    links = spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for _ in range(2):
        labels = components.connected(links)
        assert {(r.node, r.label) for r in labels.collect()} == {(k, 0) for k in range(65)}
        assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


# --- 8 ------------------------------------------------------------------------


def test_packing_holds_every_id_once_without_padding(spark):
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.choice([3, 50, 400, 3000]))) for i in range(60)] + [(None, None), (5, ""), (7, "é ½ <|endoftext|>x\x85y"), (7, "again")]
    pieces = packing.packed(docs_df(spark, rows).withColumnRenamed("lang", "shard"), PATH, shard_bytes=40_000).collect()
    own = defaultdict(bytes)
    for p in sorted(pieces, key=lambda p: p.start):
        assert len(p.ids) == 4 * p.length
        if p.doc_id not in (5, 7):
            assert p.start * 4 == len(own[p.doc_id])
            own[p.doc_id] += p.ids
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows if i not in (5, 7)}
    assert own == ids
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id]
        at[p.sequence_id] += p.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in at.values()) and sum(n == 4096 for n in at.values()) > 0.8 * len(at) - 40
    assert packing.packed(docs_df(spark, []), PATH).count() == 0


def test_seeds_fetch_their_lexical_neighbours():
    import pyarrow as pa

    from fleetlog.llm.textkit import words_of

    rnd = random.Random(1)
    topics = [prose(rnd, 60, 90).replace("w", t) for t in "abcd" for _ in range(6)]
    order = rnd.sample(range(24), 24)
    found = words_of(pa.array([topics[i] for i in order], pa.large_string()))
    pieces = packing.fill(np.full(24, 64), packing.Bm25Index(found), 384)
    together = defaultdict(set)
    for row, _, _, sequence, _ in pieces:
        together[sequence].add(order[row] // 6)
    assert [len(t) for t in together.values()] == [1, 1, 1, 1]
    assert zlib.crc32(b"") == 0


def topical(seed: int, topics: int, each: int):
    rnd = random.Random(seed)
    own = [[f"{chr(97 + t % 26)}{rnd.getrandbits(24):x}" for _ in range(60)] for t in range(topics)]
    shared = [f"w{i}" for i in range(300)]
    texts = [(t, " ".join(rnd.choice(own[t]) if rnd.random() < 0.4 else rnd.choice(shared) for _ in range(rnd.randrange(60, 140)))) for t in range(topics) for _ in range(each)]
    rnd.shuffle(texts)
    return texts


def test_windows_keep_their_topic_over_many_shards(spark):
    """Shares of a window's tokens that are of its main topic: 50 shards are as good as one."""
    texts = topical(3, 40, 25)
    df = docs_df(spark, [(i, t) for i, (_, t) in enumerate(texts)])
    share, shards = {}, {}
    for size in (64 << 20, sum(len(t) + 16 for _, t in texts) // 50):
        of = defaultdict(lambda: defaultdict(int))
        pieces = packing.packed(df, PATH, length=2048, shard_bytes=size).collect()
        for p in pieces:
            of[p.sequence_id][texts[p.doc_id][0]] += p.length
        full = [w for w in of.values() if sum(w.values()) == 2048]
        share[size] = sum(max(w.values()) for w in full) / sum(sum(w.values()) for w in full)
        shards[size] = len({s for s in of if of[s]})
        assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in {p.doc_id: p for p in pieces}.values())
    one, fifty = share.values()
    assert one > 0.5 and fifty > one - 0.05, share


def test_scores_are_bm25_with_the_corpus_counts():
    import math

    import pyarrow as pa

    from fleetlog.llm.textkit import words_of

    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randrange(1, 40), 30) for _ in range(25)] + ["", "only here"]
    split = [words(t) for t in texts]
    found = words_of(pa.array(texts, pa.large_string()))
    spread, mean = {w: 3 + len(w) for ws in split for w in ws}, 17.0
    idf = packing.inverse_frequency(1000, np.array([spread.get(w, 0) for w in found.words.to_pylist()]))
    index = packing.Bm25Index(found, idf, mean)
    for row, query in enumerate(split):
        got = index.scores(row)
        for other, ws in enumerate(split):
            want = 0.0
            for w in set(query):
                if (tf := ws.count(w)) and sum(w in x for x in split) > 1:
                    want += math.log(1 + (1000 - spread[w] + 0.5) / (spread[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            assert abs(got[other] - want) < 1e-9


def test_word_counts_cover_all_documents(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, 30, 200) for _ in range(90)] + [None, ""]
    df = docs_df(spark, texts).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(5)
    order = packing.LexicalOrder([t for t in texts if t])
    marked = df.mapInArrow(lambda b: packing._marked(b, order), packing._MARKED)
    want = np.zeros(1 << packing.CELL_BITS, np.int64)
    import pyarrow as pa
    for t in texts:
        if own := sorted(set(words(t))):
            np.add.at(want, packing._cells(packing._hashes(pa.array(own, pa.large_string()))), 1)
    assert (packing.word_spread(marked) == want).all()
    lone = packing.words_of(pa.array(["a b"], pa.large_string()))
    assert packing.LexicalOrder([]).keys(1, packing._held(lone), packing._hashes(lone.words)).tolist() == [0]
    some = pa.array(["ab", "b", "", "ab", "ba", "é" * 50], pa.large_string())
    assert len(set(packing._hashes(some).tolist())) == 5 and (packing._hashes(some.slice(1, 3)) == packing._hashes(some)[1:4]).all()


def test_chunks_of_every_form_encode_as_the_library_does():
    import pyarrow as pa

    from fleetlog.llm.textkit import words_of

    library = Tokenizer.from_file(PATH)
    texts = ["word, word. (word) it's 'S don't... été, Éa!? x2y 3.14 a'b' '' 'tis <|endoftext|>, <| a<b ſt ŉa ß. …", "HELLO!!! -- a--b ½x ª º µ. ÀÉ;;", "rock'n'roll' .'s .s' o'"]
    for text in texts:
        ids, _ = packing.encoder(PATH).encode(words_of(pa.array([text], pa.large_string())))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
