"""Periodic runs of words in whole texts (operator 11).

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping that period; runs of at least ``min_length``
words and ``min_periods`` periods count.  The texts of a slice share one
enhanced suffix array (SA, its inverse ISA and LCP); a word's code is its own in
every text, so no LCP interval joins two texts.

1. Every run ends in one branching square: suffixes i and i + q whose longest
   common prefix is exactly q.  Both are in the LCP interval of depth q, below
   different children.  An interval is taken boundary by boundary, the children
   before one against the child after it; each suffix i of the smaller side asks
   ISA[i + depth] and ISA[i - depth] whether that suffix is on the other side.
   Intervals are pairs of bounds, no tree is built, and a suffix is on a smaller
   side at most log2(n) times.
2. A square is rotated to the left while the words q apart agree, which gives its
   run.  Squares with one end merge: one whose period is a multiple of a shorter one
   inside that one's run adds nothing.

Null texts and texts without words have no run and an empty collapsed text.
Texts of any length are taken whole; a task holds one slice of a few megabytes
or one longer text.  Runs are in the order of start, then period; two runs
never agree in both.  Repeated rows each get their result, an empty table gives
no row.  Columns called ``runs``, ``n_runs`` or ``collapsed`` give way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.textkit import Words, prepare, slices, texts_of, without, words_of

MIN_LENGTH, MIN_PERIODS = 6, 4
CHUNK = 1 << 21  # suffixes asked at a time
STEPS = 48  # rotations of all squares side by side, before those left go on alone


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """SA, and for k = 0, 1, ... the ranks of the suffixes by their first 2^k words
    (equal for equal prefixes); the last ranks are ISA.  Prefix doubling, which
    sorts only suffixes that are not told apart yet."""
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    heads = np.ones(n, bool)
    heads[1:] = codes[sa[1:]] != codes[sa[:-1]]
    rank = np.full(n + 1, -1, np.int64)  # one more, for the empty suffix
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        alone = heads & np.append(heads[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            return sa, levels
        own = sa[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + width, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[at] = own = own[order]
        key = key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        heads[at] = new
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
        width *= 2


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of the suffixes at k - 1 and k, for each k (0 for k = 0)."""
    out = np.zeros(len(sa), np.int64)
    ranks = levels[0]
    at = np.flatnonzero(ranks[sa[1:]] == ranks[sa[:-1]]) + 1
    left, right = sa[at - 1].copy(), sa[at].copy()
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][left] == levels[k][right], 1 << k, 0)
        left += step
        right += step
    out[at] = left - sa[at - 1]
    return out


def _bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries k with an LCP above 0; the first suffix of their interval; and the last
    one of the child that begins at k."""
    at = np.flatnonzero((lcp > 0) | np.append(False, lcp[:-1] > 0) | np.append(lcp[1:] > 0, False))
    left, right = np.zeros(len(at), np.int64), np.full(len(at), len(lcp) - 1)
    places, values = [0], [-1]
    lefts, rights = left.tolist(), right.tolist()
    open_ = [-1]
    for k, (place, value) in enumerate(zip(at.tolist(), lcp[at].tolist())):
        while values[-1] >= value:
            rights[open_.pop()] = place - 1
            places.pop()
            values.pop()
        lefts[k] = places[-1]
        places.append(place)
        values.append(value)
        open_.append(k)
    inside = lcp[at] > 0
    return at[inside], np.array(lefts, np.int64)[inside], np.array(rights, np.int64)[inside]


def branching_squares(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next word breaks the period."""
    sa, levels = suffix_array(codes)
    lcp, isa = lcp_array(sa, levels), levels[-1]
    del levels
    at, low, high = _bounds(lcp)
    depth = lcp[at]
    smaller_left = at - low < high + 1 - at
    first = np.where(smaller_left, low, at)
    many = np.where(smaller_left, at - low, high + 1 - at)
    other_low, other_high = np.where(smaller_left, at, low), np.where(smaller_left, high, at - 1)
    starts, periods = [], []
    ends = np.cumsum(many)
    begin = 0
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, "right")))
        part = slice(begin, stop)
        sizes = many[part]
        where = np.repeat(np.arange(begin, stop), sizes)
        suffix = sa[np.arange(sizes.sum()) + np.repeat(first[part] - (np.cumsum(sizes) - sizes), sizes)]
        d, lo, hi = depth[where], other_low[where], other_high[where]
        after = isa[suffix + d]
        hit = (after >= lo) & (after <= hi)
        starts.append(suffix[hit])
        periods.append(d[hit])
        before = np.where(suffix >= d, isa[np.maximum(suffix - d, 0)], -1)
        hit = (before >= lo) & (before <= hi)
        starts.append((suffix - d)[hit])
        periods.append(d[hit])
        begin = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(codes: np.ndarray, start: np.ndarray, period: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """How far each square can be rotated to the left, down to its text's first word."""
    start = start.copy()
    live = np.arange(len(start))
    for _ in range(STEPS):
        live = live[start[live] > floor[live]]
        live = live[codes[start[live] - 1] == codes[start[live] - 1 + period[live]]]
        if not len(live):
            return start
        start[live] -= 1
    for k in live:
        s, q, low, block = int(start[k]), int(period[k]), int(floor[k]), STEPS
        while s > low:
            size = min(block, s - low)
            differ = np.flatnonzero(codes[s - size : s] != codes[s - size + q : s + q])
            if len(differ):
                s += int(differ[-1]) + 1 - size
                break
            s -= size
            block *= 2
        start[k] = s
    return start


def runs_of(codes: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of the runs of texts whose words are ``codes`` cut at
    ``offsets``, in the order of row, start and period."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none, none
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = rows * (int(codes.max()) + 1) + codes
    start, period = branching_squares(own)
    end = start + 2 * period
    floor = offsets[rows[start]]
    long_enough = end - floor >= np.maximum(min_length, min_periods * period)
    start, period, end, floor = start[long_enough], period[long_enough], end[long_enough], floor[long_enough]
    order = np.lexsort((period, end))
    start, period, end, floor = start[order], period[order], end[order], floor[order]
    found = []
    while len(start):
        # squares with one end: the shortest gives a run, its multiples inside go
        shortest = np.ones(len(end), bool)
        shortest[1:] = end[1:] != end[:-1]
        first = _rotated(own, start[shortest], period[shortest], floor[shortest])
        found.append((first, end[shortest], period[shortest]))
        of = np.cumsum(shortest) - 1
        merged = (period % period[shortest][of] == 0) & (end - first[of] >= 2 * period)
        start, period, end, floor = (x[~merged] for x in (start, period, end, floor))
    if not found:
        return none, none, none, none
    start, end, period = (np.concatenate(x) for x in zip(*found))
    keep = end - start >= np.maximum(min_length, min_periods * period)
    start, end, period = start[keep], end[keep], period[keep]
    row = rows[start]
    order = np.lexsort((period, start, row))
    start, end, period, row = start[order], end[order], period[order], row[order]
    return row, start - offsets[row], end - start, period


def periodic_runs(
    docs: DataFrame,
    text_column: str = "text",
    min_length: int = MIN_LENGTH,
    min_periods: int = MIN_PERIODS,
    edit: Callable[[pa.RecordBatch, Words], Words] | None = None,
) -> DataFrame:
    """``docs`` with ``n_runs``, ``runs`` (array of start, length and period in words, by
    start, then period) and ``collapsed``: the words, joined by one blank, without
    those that a run has after its first period.  ``edit`` may replace the words
    of a slice (same rows) before they are searched."""
    prepare(docs.sparkSession)
    docs = without(docs, "runs", "n_runs", "collapsed")
    names = docs.columns
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                found = words_of(texts_of(part, text_column))
                if edit:
                    found = edit(part, found)
                offsets, codes = found.offsets, found.codes.astype(np.int64)
                row, start, length, period = runs_of(codes, offsets, min_length, min_periods)
                edges = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edges, offsets[row] + start + period, 1)
                np.add.at(edges, offsets[row] + start + length, -1)
                keep = np.cumsum(edges[:-1]) == 0
                words = found.words.cast(pa.large_binary()).to_pylist()
                codes = codes.tolist()
                texts = [
                    b" ".join(map(words.__getitem__, compress(codes[a:b], keep[a:b]))).decode()
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                ]
                many = np.bincount(row, minlength=part.num_rows)
                listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(run))
                bounds = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(many, pa.int64()), pa.ListArray.from_arrays(bounds, listed), pa.array(texts, pa.string())],
                    [*names, "n_runs", "runs", "collapsed"],
                )

    kinds = {"n_runs": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
    schema = docs.withColumns({n: F.lit(None).cast(kind) for n, kind in kinds.items()}).schema
    return docs.mapInArrow(find, schema)
