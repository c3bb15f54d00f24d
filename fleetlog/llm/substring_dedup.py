"""Removal of repeated passages behind a count-min prefilter (operator 7).

A window is ``width`` consecutive words of one document, known by two independent
64-bit hashes: the first gives its cell, the second is grouped, so two different windows are
taken for one only if both estimates and the second hash agree.
Documents are read in slices of bounded size.

1. Each slice makes a count-min sketch of its windows: the cells that it hits,
   counted up to two.  Sketches are sparse and cut into blocks of cells; the
   merge of a block adds the sketches of all slices and answers each slice with
   one bit for each of its cells, whether the cell's sum is two or more.  A sum
   is never below the number of windows, so no repeated window is lost.
2. Each slice sends the second hashes of the windows estimated as repeated, again
   by blocks and counted up to two, which are grouped exactly and answered alike.
3. Each slice removes the words covered by windows found repeated.

Blocks hold a bounded number of cells, a slice sends a window at most twice
however often it has it, and the sketch's width follows the number of windows,
so neither a passage in every document nor the size of the input makes a task
large.  Answers are bits, cut from lineage by a checkpoint; nothing is broadcast
or collected.

Null texts have no words and stay null.  Documents with fewer words than a window
lose nothing.  A repeated row repeats its windows, so both rows lose them.  Words
are compared unchanged, windows on the input alone.

Slices are cut once, over all columns, and checkpointed as one compressed value
each; the three passes read those, so how Arrow cuts its batches does not matter
and ``docs`` is read once.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.textkit import Words, checkpointed, hash_words, prepare, row_sums, slices, window_hashes, without, words_of

WIDTH = 35
BLOCK_WINDOWS = 4 << 20  # windows that meet in one block
MIN_BLOCK_BITS = 6
CELLS_PER_WINDOW_BITS = 5
SECOND = 1  # seed of the second hash
_ANSWER = "slice long, check long, block int, bits binary"


def _windows(found: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    if not len(found.codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return window_hashes(hash_words(found.words, seed)[found.codes], found.offsets, width)


def _check(hashes: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(hashes, initial=np.uint64(len(hashes))).astype(np.int64))


def _upto_two(keys: np.ndarray) -> np.ndarray:
    """Sorted, with at most two of each key."""
    keys = np.sort(keys)
    third = np.zeros(len(keys), bool)
    third[2:] = keys[2:] == keys[:-2]
    return keys[~third]


class Layout:
    """Cells and blocks for about ``windows`` windows."""

    def __init__(self, windows: int):
        self.block_bits = max(MIN_BLOCK_BITS, int(np.ceil(np.log2(max(1, windows) / BLOCK_WINDOWS))))
        self.cell_bits = min(56, max(self.block_bits + 16, int(np.ceil(np.log2(max(1, windows)))) + CELLS_PER_WINDOW_BITS))

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.cell_bits)

    def cut(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """Where each block begins in sorted keys of so many bits."""
        edges = np.arange(1, 1 << self.block_bits, dtype=np.uint64) << np.uint64(bits - self.block_bits)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])

    def pack(self, cells: np.ndarray) -> bytes:
        """Sorted cells of one block: how many share their upper bits, and the lower 16 bits of each."""
        high = (cells >> np.uint64(16)) & np.uint64((1 << (self.cell_bits - self.block_bits - 16)) - 1)
        counts = np.bincount(high.astype(np.int64), minlength=1 << (self.cell_bits - self.block_bits - 16))
        return counts.astype("<u4").tobytes() + cells.astype("<u2").tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        size = 4 << (self.cell_bits - self.block_bits - 16)
        counts = np.frombuffer(raw[:size], "<u4")
        return (np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(16)) | np.frombuffer(raw[size:], "<u2")


def _answer(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """For each piece of keys, which of its keys occur twice or more in all."""
    keys = np.concatenate(pieces)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.split(hit, np.cumsum([len(p) for p in pieces])[:-1])


def _bits(keys: np.ndarray, edges: np.ndarray, answers: pa.Table, check: int) -> np.ndarray:
    """The answered bit of each sorted key."""
    hit = np.zeros(len(keys), bool)
    for block, raw, told in zip(answers["block"].to_pylist(), answers["bits"].to_pylist(), answers["check"].to_pylist()):
        if told != check:
            raise RuntimeError("a slice of the documents changed between two reads")
        a, b = edges[block], edges[block + 1]
        hit[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a)
    return hit


def _estimated(hashes: np.ndarray, layout: Layout, answers: pa.Table) -> np.ndarray:
    """Which windows are estimated as repeated."""
    cells = _upto_two(layout.cells(hashes))
    hit = cells[_bits(cells, layout.cut(cells, layout.cell_bits), answers, _check(hashes))]
    return _member(layout.cells(hashes), hit)


def _member(keys: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ranked, keys)
    at[at == len(ranked)] = 0
    return ranked[at] == keys


def _sent(keys: np.ndarray, edges: np.ndarray, pack, number: int, check: int) -> pa.RecordBatch:
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(full), number), pa.int64()),
            pa.array(np.full(len(full), check), pa.int64()),
            pa.array(full, pa.int32()),
            pa.array([pack(keys[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
        ],
        ["slice", "check", "block", "bits"],
    )


def _numbered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, column):
            yield number, part
            number += 1


def _packed(part: pa.RecordBatch) -> bytes:
    """The rows of a slice as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(part)
    return sink.getvalue().to_pybytes()


def _rows(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def _merged(sent: DataFrame, unpack) -> DataFrame:
    def merge(block: pa.Table) -> pa.Table:
        hits = _answer([unpack(raw) for raw in block["bits"].to_pylist()])
        return block.set_column(3, "bits", pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()))

    return checkpointed(sent.groupBy("block").applyInArrow(merge, _ANSWER))


def without_repeats(docs: DataFrame, width: int = WIDTH, text_column: str = "text", joined: bool = False) -> DataFrame:
    """``docs`` without the words of repeated windows, and the columns
    ``n_words`` and ``n_removed``.  Kept words of a text that lost some are joined
    by one blank; other texts stay as they are unless ``joined``.  Columns of these
    names and ``_slice`` in ``docs`` give way."""
    prepare(docs.sparkSession)
    docs = without(docs, "n_words", "n_removed", "_slice")
    names = [f.name for f in docs.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _numbered(batches, text_column):
            size = pc.sum(pc.binary_length(part.column(text_column))).as_py() or 0
            yield pa.RecordBatch.from_pydict({"_slice": [number], "size": [size], "rows": [_packed(part)]}, kept)

    kept = pa.schema([("_slice", pa.int64()), ("size", pa.int64()), ("rows", pa.binary())])
    whole = checkpointed(docs.mapInArrow(cut, "_slice long, size long, rows binary"))
    layout = Layout((whole.agg(F.sum("size")).first()[0] or 0) // 6)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, value in zip(batch.column("_slice").to_pylist(), batch.column("rows")):
                hashes, _ = _windows(words_of(_texts(_rows(value))), width)
                cells = _upto_two(layout.cells(hashes))
                yield _sent(cells, layout.cut(cells, layout.cell_bits), layout.pack, number, _check(hashes))
            pa.default_memory_pool().release_unused()  # workers live on and share the executor's memory

    def _texts(rows: pa.Table) -> pa.Array:
        return pc.fill_null(rows[text_column].cast(pa.large_string()), "").combine_chunks()

    def exact(left: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return pa.Table.from_batches([], schema)
        words = words_of(_texts(_rows(left["rows"][0])))
        hashes, _ = _windows(words, width)
        found = _upto_two(_windows(words, width, SECOND)[0][_estimated(hashes, layout, answers)])
        return pa.Table.from_batches([_sent(found, layout.cut(found, 64), lambda keys: keys.tobytes(), left["_slice"][0].as_py(), _check(hashes))])

    def remove(left: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(left["rows"][0])
        found = words_of(_texts(rows))
        hashes, first = _windows(found, width)
        maybe = np.flatnonzero(_estimated(hashes, layout, answers.filter(pc.equal(answers["phase"], 1))))
        second = _windows(found, width, SECOND)[0][maybe]
        candidates = _upto_two(second)
        hit = _bits(candidates, layout.cut(candidates, 64), answers.filter(pc.equal(answers["phase"], 2)), _check(hashes))
        edges = np.zeros(len(found.codes) + 1, np.int64)
        again = first[maybe[_member(second, candidates[hit])]]
        edges[again] += 1
        edges[again + width] -= 1
        keep = np.cumsum(edges[:-1]) == 0
        removed = row_sums(~keep, found.offsets)
        out = rows[text_column].to_pylist()
        for i in range(len(out)) if joined else np.flatnonzero(removed):
            words = (out[i] or "").encode().split()
            out[i] = b" ".join(compress(words, keep[found.offsets[i] : found.offsets[i + 1]]) if removed[i] else words).decode()
        columns = [pa.array(out, pa.string()) if n == text_column else rows[n] for n in names]
        return pa.Table.from_arrays([*columns, pa.array(found.lengths, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    schema = pa.schema([("slice", pa.int64()), ("check", pa.int64()), ("block", pa.int32()), ("bits", pa.binary())])
    first = _merged(whole.mapInArrow(sketch, _ANSWER), layout.unpack)
    second = _merged(
        whole.groupBy("_slice").cogroup(first.groupBy("slice")).applyInArrow(exact, _ANSWER), lambda raw: np.frombuffer(raw, np.uint64)
    )
    answers = first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return whole.groupBy("_slice").cogroup(answers.groupBy("slice")).applyInArrow(remove, out)
