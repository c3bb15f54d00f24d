"""Quality rules by distribution divergence (operator 9).

Each text gives two histograms: its characters over a few classes, and its
words over the common words of the corpus.  Each is compared by Jensen-Shannon
distance with a reference of every language, which is gathered from all
documents of that language.  A text is turned down when even its nearest
language is too far off in either; guards on length keep short texts, whose
histograms are mostly chance, out of that comparison.

Null texts have no words; rows with null language take part in no reference
but are judged like the others.  Without any reference (empty table, no
languages) only the base rules judge.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.textkit import Words, checkpointed, hash_words, lines_of, mix, prepare, repeated, row_sums, slices, texts_of, window_hashes, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Character classes, in this order; what is left over is the last class.
CLASSES = (r"\p{Ll}", r"[\p{Lu}\p{Lt}]", r"[\p{Lo}\p{Lm}\p{M}]", r"\p{N}", r"[.,;:!?'\"()-]", SYMBOLS)
REPEAT_WIDTH = 5


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10  # base rule
    max_repeat_percent: int = 20  # base rule
    common_share: float = 0.002  # a language's common words have this share of its words
    min_class_chars: int = 200  # guard: characters needed for the class histogram
    min_common_words: int = 50  # guard: words needed for the word histogram
    max_class_distance: float = 0.28
    max_word_distance: float = 0.80


def _classes(words: pa.Array) -> np.ndarray:
    """Characters of each word by class."""
    counts = [pc.count_substring_regex(words, pattern=p).to_numpy(zero_copy_only=False) for p in CLASSES]
    rest = pc.utf8_length(words).to_numpy(zero_copy_only=False) - sum(counts)
    return np.stack([*counts, rest], axis=1).astype(np.int64)


def _plain(words: pa.Array) -> pa.Array:
    """Words in lower case without what surrounds their letters."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}]+|[^\p{L}]+$", "")).cast(pa.string())


def references(docs: DataFrame, rules: QualityRules = QualityRules()) -> tuple[dict[str, np.ndarray], dict[str, dict[str, float]]]:
    """Class histogram and common-word shares of each language, over all
    documents.  All plain words are counted and summed by language
    and word; ``common_share`` applies to the sums alone, so at most
    1 / ``common_share`` words of each language pass through the driver."""
    prepare(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("class", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        total: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                found = words_of(texts_of(part))
                if not len(found.words):
                    continue
                per_class, plain = _classes(found.words), _plain(found.words).dictionary_encode()
                form = plain.indices.to_numpy()
                worded = pc.not_equal(plain.dictionary, "").to_numpy(zero_copy_only=False)
                langs = part.column("lang").dictionary_encode()
                own = langs.indices.to_numpy(zero_copy_only=False)[found.rows()]
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    n = np.bincount(found.codes[own == i], minlength=len(found.words))
                    chars[lang] = chars.get(lang, 0) + n @ per_class
                    total[lang] = total.get(lang, 0) + int(n.sum())
                    sums = np.bincount(form, weights=n, minlength=len(plain.dictionary)).astype(np.int64)
                    at = np.flatnonzero((sums > 0) & worded)
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), len(at)), plain.dictionary.take(pa.array(at)), pa.array(sums[at]), pa.array(np.full(len(at), -1, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
        rows = [(lang, None, int(v), k) for lang, c in chars.items() for k, v in enumerate(c)]
        rows += [(lang, None, v, -1) for lang, v in total.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    counted = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(
        count, "lang string, word string, n long, class int"
    )
    summed = checkpointed(counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")))
    whole = summed.filter("word IS NULL AND class = -1").select("lang", F.col("n").alias("whole"))
    rows = summed.join(F.broadcast(whole), "lang").filter(F.col("word").isNull() | (F.col("n") >= rules.common_share * F.col("whole"))).collect()
    chars: dict[str, np.ndarray] = {}
    common: dict[str, dict[str, float]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.word or "")):
        if r.word is not None:
            common.setdefault(r.lang, {})[r.word] = r.n / r.whole
        elif r["class"] >= 0:
            chars.setdefault(r.lang, np.zeros(len(CLASSES) + 1))[r["class"]] = r.n
    chars = {k: v / v.sum() for k, v in chars.items() if v.sum()}
    return chars, {k: common.get(k, {}) for k in chars}


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` from ``q``."""
    m = (p + q) / 2

    def divergence(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.sqrt(np.clip((divergence(p) + divergence(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def _nearest(counts: np.ndarray, refs: list[np.ndarray]) -> np.ndarray:
    totals = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.min([_distance(counts / totals, q) for q in refs], axis=0) if refs else np.zeros(len(counts))


def _duplicate_lines(lines: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the row, counted by row."""
    worded = pc.match_substring_regex(lines.words, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[lines.codes]
    rows, codes = lines.rows()[worded], lines.codes[worded].astype(np.int64)
    n = len(lines.offsets) - 1
    _, first = np.unique(rows * (len(lines.words) + 1) + codes, return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def _repeat_words(found: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in windows of ``REPEAT_WIDTH`` words that stand twice or more in
    the row, the first one included, counted by row."""
    keys, at = window_hashes(hashes, found.offsets, REPEAT_WIDTH)
    again = at[repeated(mix(keys + found.rows()[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))]
    edges = np.zeros(len(found.codes) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + REPEAT_WIDTH, -1)
    return row_sums(np.cumsum(edges[:-1]) > 0, found.offsets)


def judged(docs: DataFrame, rules: QualityRules = QualityRules(), refs: tuple | None = None) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept`` of every row."""
    prepare(docs.sparkSession)
    chars, common = refs or references(docs, rules)
    vocabulary = sorted({w for seen in common.values() for w in seen})
    index = {w: i for i, w in enumerate(vocabulary)}
    word_refs = []
    for lang in chars:
        shares = np.zeros(len(vocabulary) + 1)
        for w, share in common[lang].items():
            shares[index[w]] = share
        shares[-1] = max(0.0, 1 - shares.sum())
        word_refs.append(shares)
    char_refs = [*chars.values()]
    width = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                found = words_of(texts)
                rows, n = found.rows(), part.num_rows
                n_words = found.lengths
                per_class = _classes(found.words) if len(found.words) else np.zeros((0, len(CLASSES) + 1), np.int64)
                classes = np.stack([row_sums(per_class[found.codes, k], found.offsets) for k in range(len(CLASSES) + 1)], axis=1)
                known = np.array([index.get(w, width - 1) for w in _plain(found.words).to_pylist()], np.int64)
                counts = np.bincount(rows * width + known[found.codes], minlength=n * width).reshape(n, width) if len(rows) else np.zeros((n, width))
                repeat = _repeat_words(found, hash_words(found.words)[found.codes]) if len(rows) else np.zeros(n, np.int64)
                base = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
                by_class, by_word = _nearest(classes, char_refs), _nearest(counts, word_refs)
                far = (classes.sum(axis=1) >= rules.min_class_chars) & (by_class > rules.max_class_distance)
                far |= (n_words >= rules.min_common_words) & (by_word > rules.max_word_distance)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, classes.sum(axis=1), classes[:, CLASSES.index(SYMBOLS)], _duplicate_lines(lines_of(texts)), repeat)), pa.array(base), pa.array(by_class), pa.array(by_word), pa.array(~base & ~far)],
                    names,
                )

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    types = ["long"] * 6 + ["boolean", "double", "double", "boolean"]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(map(" ".join, zip(names, types))))
