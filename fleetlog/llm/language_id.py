"""Language identification of mixed text (operator 1).

The script of a word narrows its candidate languages; each candidate scores
the word by the smoothed log-probabilities of its byte n-grams; Viterbi
decoding over the words of a text, with a penalty for each switch, labels every
word.  Runs of one label are the spans; the language that covers most letters
is the text's language and its share of the letters is the score.

The model is fitted on at most ``sample_rows`` labelled texts, the first in the
order of their hash; every text is then labelled whole, of whatever length (a task
holds a slice of a few megabytes or one longer text).  Texts that are
null or have no letter give ``und`` and score 0.  A script that no training text
uses narrows nothing: its words are candidates of all languages.  Combining marks
are no letters.  Repeated rows give repeated results, an empty table gives none,
an empty training set labels everything ``und``, and of equal scores the language
first in alphabetical order wins.  Columns other than id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fleetlog.llm.textkit import Words, bounded_sample, byte_grams, mix, prepare, slices, texts_of, words_of

SAMPLE_ROWS = 4_000
SWITCH_PENALTY = 12.0
GRAM_SIZES = (2, 3, 4)
TABLE_BITS = 18
UNKNOWN = "und"

#: First code points of the blocks of each script; what lies between belongs to
#: the script before it.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Common"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # gram cell x language: log-probability
    scripts: np.ndarray  # script x language: whether the language uses it


def _letters(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each word's letters in lower case, how many, and the script of the first."""
    bare = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{M}]+", ""))
    first = pc.utf8_slice_codeunits(bare, 0, 1)
    points = np.fromiter((ord(c) if c else 0x2000 for c in first.to_pylist()), np.int64, len(first))
    letters = pc.utf8_length(bare).to_numpy(zero_copy_only=False).copy()
    marked = pc.indices_nonzero(pc.invert(pc.utf8_is_alpha(bare)))  # empty, or with marks
    if len(marked):
        letters[marked] = pc.utf8_length(pc.replace_substring_regex(bare.take(marked), r"\p{M}+", ""))
    return bare, letters, _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1]


def _cells(bare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    grams, owner = byte_grams(bare, GRAM_SIZES)
    return (mix(grams) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), owner


def fit(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on ``text, lang``; rows with null text or lang are left out."""
    prepare(training.sparkSession)
    sample = bounded_sample(training.select("text", "lang").dropna(), sample_rows).toArrow()
    languages = sorted(set(sample["lang"].to_pylist()))
    counts = np.zeros((1 << TABLE_BITS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for batch in sample.combine_chunks().to_batches(max_chunksize=1000):
        for part in slices(batch, "text"):
            found = words_of(texts_of(part))
            if not len(found.words):
                continue
            bare, letters, script = _letters(found.words)
            cells, owner = _cells(bare)
            own = np.array([languages.index(x) for x in part.column("lang").to_pylist()])[found.rows()]
            for k in range(len(languages)):
                n = np.bincount(found.codes[own == k], minlength=len(found.words)) * (letters > 0)
                counts[:, k] += np.bincount(cells, weights=n[owner], minlength=1 << TABLE_BITS)
                scripts[:, k] += np.bincount(script, weights=n, minlength=len(_NAMES))
    smooth = counts + 0.5
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), share >= 0.001)


def word_scores(model: LanguageModel, bare: pa.Array, letters: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Word x language: mean gram log-probability times the word's letters,
    relative to the best candidate; words without a letter score 0 throughout."""
    n = len(bare)
    cells, owner = _cells(bare)
    sums = np.stack([np.bincount(owner, weights=model.weights[cells, k], minlength=n) for k in range(len(model.languages))], axis=1)
    scores = sums / np.maximum(np.bincount(owner, minlength=n), 1)[:, None] * np.minimum(letters, 20)[:, None]
    allowed = model.scripts[script]
    allowed = allowed | ~allowed.any(axis=1)[:, None]
    scores = np.where(allowed, scores, -1e6)
    return np.where((letters > 0)[:, None], scores - scores.max(axis=1, keepdims=True), 0.0)


def viterbi(scores: np.ndarray, found: Words, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word, all rows of a slice in step: a row's best
    path either stays with a label or pays the penalty and comes from the best."""
    codes, offsets, lengths = found.codes, found.offsets, found.lengths
    labels = np.zeros(len(codes), np.int64)
    stay = np.zeros((len(codes), scores.shape[1]), bool)
    origin = np.zeros(len(codes), np.int64)  # best label of the word before
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at, longest = offsets[:-1][order], lengths[order]
    live = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), "right")
    value = scores[codes[at]]
    for t in range(1, len(live)):
        value = value[: live[t]]
        here = at[: live[t]] + t
        best = value.argmax(axis=1)
        top = value[np.arange(len(best)), best][:, None] - penalty
        keep = value >= top
        stay[here], origin[here] = keep, best
        value = np.where(keep, value, top) + scores[codes[here]]
        # each row's last word ends its path
        ends = live[t + 1] if t + 1 < len(live) else 0
        labels[here[ends:]] = value[ends:].argmax(axis=1)
    single = at[live[1] if len(live) > 1 else 0 :]
    labels[single] = scores[codes[single]].argmax(axis=1)
    for t in range(len(live) - 1, 0, -1):
        here = at[: live[t]] + t
        now = labels[here]
        labels[here - 1] = np.where(stay[here, now], now, origin[here])
    return labels


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row.  A span is
    ``(start, end, lang)`` in words of the text, end excluded; words without a
    letter take the label of the path around them."""
    prepare(docs.sparkSession)
    languages = np.array([*model.languages, UNKNOWN], object)
    k = len(model.languages)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, n = words_of(texts_of(part)), part.num_rows
                cover = np.zeros((n, k + 1))
                starts, firsts, lasts, names = np.zeros(n + 1, np.int64), [], [], []
                if k and len(found.codes):
                    bare, letters, script = _letters(found.words)
                    claimed = letters > 0
                    labels = viterbi(word_scores(model, bare, letters, script), found, penalty)
                    rows = found.rows()
                    cover = np.bincount(rows * (k + 1) + np.where(claimed[found.codes], labels, k), weights=letters[found.codes], minlength=n * (k + 1)).reshape(n, k + 1)
                    new = np.ones(len(labels), bool)
                    new[1:] = (labels[1:] != labels[:-1]) | (rows[1:] != rows[:-1])
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(labels))
                    base = found.offsets[:-1][rows[begin]]
                    firsts, lasts, names = begin - base, end - base, languages[labels[begin]]
                    starts = np.concatenate([[0], np.cumsum(np.bincount(rows[begin], minlength=n))])
                spans = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(names, pa.string())], fields=[*span]))
                best = cover[:, :k].argmax(axis=1) if k else np.zeros(n, np.int64)
                share = cover[np.arange(n), best] / np.maximum(cover.sum(axis=1), 1) if k else np.zeros(n)
                known = share > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.where(known, languages[best], UNKNOWN), pa.string()), pa.array(np.where(known, share, 0.0)), spans],
                    ["doc_id", "lang_pred", "score", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
