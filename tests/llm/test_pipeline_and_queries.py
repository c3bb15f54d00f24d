"""The registered queries against their SQL, and the pipeline against plain versions."""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from brute import near_components, without_windows, words

import corpus_pipeline
from fleetlog.llm import queries, sql
from fleetlog.llm.textkit import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op3_top_k": ["query_id", "rank", "vec_id", "score"],
    "op4_html_text": ["page_id", "url", "text", "n_chars"],
    "op5_line_dedup": ["doc_id", "n_lines", "n_removed", "text"],
    "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_toxicity": ["doc_id", "p_toxic", "toxic"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


def test_every_operator_has_a_query():
    assert set(queries.queries()) == set(COLUMNS) and set(sql.queries()) <= set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_columns_and_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert set(COLUMNS[name]) <= set(df.columns)
    if name not in ("op3_top_k", "op4_html_text", "op8_packing", "op12_conversation_trie"):
        assert len(rows) == 200
    if statement := sql.queries().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cursor = con.execute(statement)
        order = [d[0] for d in cursor.description]
        want = sorted(map(repr, cursor.fetchall()))
        assert sorted(repr(tuple(r[c] for c in order)) for r in rows) == want


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "substring_dedup", "packing"]
    held = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = held[name] = stored(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
    rows = {k: {r.doc_id: r for r in df.collect()} for k, df in held.items() if k != "packing"}
    verdicts = {r.doc_id: r.toxic for r in queries.op10_toxicity(spark, SF).collect()}
    assert set(rows["toxicity"]) == {i for i, bad in verdicts.items() if not bad}
    assert set(rows["line_dedup"]) == set(rows["toxicity"])
    for i, r in rows["line_dedup"].items():
        before = rows["toxicity"][i].text
        assert len(r.text) == r.n_chars and set(r.text.split("\n")) <= set(before.split("\n"))
    near = near_components([(i, r.text) for i, r in rows["line_dedup"].items()])
    assert set(rows["ngram_join"]) == {c for _, n, c in near if n} | {i for i, n, _ in near if not n}
    order = sorted(rows["ngram_join"])
    for i, (n, gone, kept) in zip(order, without_windows([rows["ngram_join"][i].text for i in order])):
        assert words(rows["substring_dedup"][i].text) == kept
    ids = {r.doc_id: r.n_tokens for r in queries.bpe.round_trip(held["substring_dedup"], queries.VOCABULARY).collect()}
    length = {}
    for p in held["packing"].collect():
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
    assert length == {i: n + 1 for i, n in ids.items()}


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == COLUMNS["op8_packing"] and 100 < out.select("doc_id").distinct().count() <= 200


def test_nothing_else_imports_the_subpackage():
    import fleetlog

    root = os.path.dirname(fleetlog.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in (f for f in files if f.endswith(".py")):
                assert not re.search(r"fleetlog\.llm|corpus_pipeline", open(os.path.join(folder, f)).read()), f
