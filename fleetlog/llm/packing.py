"""Packing of documents into token sequences by lexical retrieval (operator 8).

1. Documents get a place in a lexical order: on a bounded sample of texts
   (``SAMPLE_ROWS``) centroids of word vectors are fitted and put into a
   tour of neighbours, and a document's key is the tour places of its nearest
   centroids.  Neighbours of any number lie together in that order, so it
   can be cut into as many shards as the input needs.  The same pass counts, over
   all documents, how many have a word (in cells of the words' hashes) and how
   long they are.
2. The order is dealt by ranges of (key, id), so a key of a third of all rows is
   split; each task cuts its range into shards of bounded size and builds a BM25
   inverted index for each, with the document counts and the mean length of the
   whole corpus.  Every seed document asks it for its unused neighbours, and these
   fill the seed's window from the best on.  The document that no longer fits is cut
   and seeds the next window with its rest, so all windows are full but the last of
   a shard, which is cut into sequences whose lengths are powers of two: none needs
   padding.

A document is the ids of its text and the end id.  Null and empty texts are the
end id alone.  Documents of any length are cut over as many windows as they
need; a shard is as large as its longest document may be.  Of equal scores the document first in the order of id and text wins;
documents without a common word come last, in that order.  Repeated rows are
documents of their own.  An empty table gives no row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.bpe import codec
from fleetlog.llm.textkit import ODD, Words, bounded_sample, checkpointed, mix, prepare, slices, texts_of, words_of

LENGTH = 4096
END_ID = 2
SHARD_BYTES = 6 << 20
CACHE_ENTRIES = 250_000  # words in each of the two generations of a worker's cache
K1, B = 1.2, 0.75
SAMPLE_ROWS = 4_096  # different texts that the order is fitted on
TERMS, CENTROIDS, NEAREST = 2_048, 128, 3
CELL_BITS, BLOCK_BITS = 18, 12  # cells of the document counts, and those of one block
RANGES = 1 << 16  # tasks at most; each goes through its range shard by shard


def _gather(codes: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (``sizes`` long, end to end) that the codes name, joined, and
    where each code's run begins and the last one ends."""
    many = sizes[codes]
    ends = np.cumsum(many)
    starts = np.concatenate([[0], ends]).astype(np.int64)
    if not len(codes):
        return values[:0], starts
    first = np.cumsum(sizes) - sizes
    return values[np.arange(starts[-1]) + np.repeat(first[codes] - starts[:-1], many)], starts


class ChunkEncoder:
    """Ids of texts by their white-space-separated chunks, which the vocabulary never
    joins, and those by their words, which the library's model splits: every step runs
    once for each different chunk or word of a shard."""

    #: Chunks of these characters alone are normalised by lower case and cut by the pattern
    #: in Arrow; the others, and those with special strings, by the rules one by one.
    PLAIN = "^[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]*$"

    #: Lower-case letters of PLAIN, and the marks that may follow them as one word (an
    #: apostrophe may begin one with letters).
    LETTERS = "".join(c for c in map(chr, range(0x61, 0x17F)) if c.isalpha())
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.rules = codec(path)
        self.model = self.rules.library.model
        self.cut = "(" + self.rules.words.pattern + ")"
        #: no word looks like the name of a special string: words are never control and digit
        self.names = {i: f"\0{i}" for i in self.rules.special.values()}
        self.fixed = {name: i.to_bytes(4, "little") for i, name in self.names.items()}
        self.new: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word.  Words are remembered in two generations: those not asked
        for while one filled up are forgotten."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, dict(self.fixed)
        new, old, model, symbols = self.new, self.old, self.model, self.rules.symbols
        out = [new.get(w) for w in words]
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                ids = old.get(w)
                if ids is None:
                    ids = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(symbols(w))]) if w else b""
                if len(w) <= 64:
                    new[w] = ids
                out[i] = ids
        return out

    def encode(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows)"""
        if not len(found.words):
            return np.zeros(0, "<u4"), np.zeros(len(found.offsets), np.int64)
        plain = pc.and_(pc.match_substring_regex(found.words, self.PLAIN), pc.invert(pc.match_substring(found.words, "<|")))
        lower = pc.utf8_lower(found.words)
        # letters and then marks are two words; the pattern cuts what is of another form
        letters, marks = pc.utf8_rtrim(lower, self.MARKS), pc.utf8_ltrim(lower, self.LETTERS)
        simple = pc.and_(plain, pc.utf8_is_alpha(letters))
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.binary_join_element_wise(letters, space, marks, space, nothing)
        if len(mixed := pc.indices_nonzero(pc.invert(simple))):
            spaced = pc.replace_with_mask(spaced, pc.invert(simple), pc.replace_substring_regex(lower.take(mixed), self.cut, r"\1 "))
        odd = pc.indices_nonzero(pc.invert(plain))
        if len(odd):
            own = [" ".join(self.names[p] if isinstance(p, int) else p for p in self.rules.parts(c)) + " " for c in found.words.take(odd).to_pylist()]
            spaced = pc.replace_with_mask(spaced, pc.invert(plain), pa.array(own, pa.large_string()))
        parts = words_of(spaced)
        runs = self._ids(parts.words.to_pylist())
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        ids = np.frombuffer(b"".join(runs), "<u4")
        chunk_ids, starts = _gather(parts.codes, ids, sizes)
        chunk_sizes = starts[parts.offsets[1:]] - starts[parts.offsets[:-1]]
        out, starts = _gather(found.codes, chunk_ids, chunk_sizes)
        return out, starts[found.offsets]


@cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and worker."""
    return ChunkEncoder(path)


class Bm25Index:
    """Inverted index over the words of a shard's documents.  ``idf`` of its words and the
    ``mean`` length are those of the corpus; without them the shard is the corpus."""

    def __init__(self, found: Words, idf: np.ndarray | None = None, mean: float | None = None):
        n, width = len(found.offsets) - 1, max(1, len(found.words))
        rows, terms, counts = _held(found)
        spread = np.bincount(terms, minlength=width)
        shared = spread[terms] > 1  # others lead to no neighbour
        rows, terms, counts = rows[shared], terms[shared], counts[shared]
        self.size = n
        self.terms, self.term_starts = terms, np.searchsorted(rows, np.arange(n + 1))
        order = np.argsort(terms, kind="stable")
        self.rows, self.row_starts = rows[order], np.searchsorted(terms[order], np.arange(width + 1))
        if mean is None:
            mean = found.lengths.mean() if n else 1.0
        lengths = found.lengths / max(1.0, mean)
        idf = inverse_frequency(n, spread) if idf is None else idf
        tf = counts[order]
        self.weights = idf[terms[order]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.rows]))

    def scores(self, row: int) -> np.ndarray:
        """The score of every document for the words of one."""
        terms = self.terms[self.term_starts[row] : self.term_starts[row + 1]]
        starts, ends = self.row_starts[terms], self.row_starts[terms + 1]
        many = ends - starts
        if not many.sum():
            return np.zeros(self.size)
        at = np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)
        return np.bincount(self.rows[at], weights=self.weights[at], minlength=self.size)


def inverse_frequency(n: int, spread: np.ndarray) -> np.ndarray:
    """BM25's weight of words that ``spread`` of n documents have."""
    return np.log(1 + np.maximum(n - spread + 0.5, 0.5) / (spread + 0.5))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _held(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of each row's different words, sorted."""
    width = max(1, len(found.words))
    pairs = np.sort(found.rows() * width + found.codes)
    head = np.ones(len(pairs), bool)
    head[1:] = pairs[1:] != pairs[:-1]
    at = np.flatnonzero(head)
    return *np.divmod(pairs[at], width), np.diff(np.append(at, len(pairs)))


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words' bytes, by sums of powers over all of them at once; for
    counts and places, where two words that fall together do no harm."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    up, down = np.full(len(raw) + 1, ODD), np.full(len(raw) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * np.cumprod(up, dtype=np.uint64)[:-1], dtype=np.uint64)])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * np.cumprod(down, dtype=np.uint64)[offsets[:-1]])


class LexicalOrder:
    """Centroids of word vectors in a tour, fitted on a sample of texts."""

    def __init__(self, texts: list[str], terms: int = TERMS, centroids: int = CENTROIDS, rounds: int = 8):
        found = words_of(pa.array(texts, pa.large_string()))
        n = len(texts)
        spread = np.bincount(_held(found)[1], minlength=len(found.words))
        # words of several texts, but not of most, the ones of most texts first
        usable = np.flatnonzero((spread >= 2) & (5 * spread <= 2 * n))
        usable = usable[np.argsort(-spread[usable], kind="stable")[:terms]]
        hashes = _hashes(found.words.take(pa.array(usable)))
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], inverse_frequency(n, spread[usable[order]]).astype(np.float32)
        self.centroids = np.zeros((1, len(self.hashes)), np.float32)
        if not len(self.hashes):
            return
        vectors = self.vectors(n, _held(found), _hashes(found.words))
        vectors = vectors[vectors.any(axis=1)]
        k = max(1, min(centroids, len(vectors) // 16))
        # spread starts: each the text that is the least like those before it
        start, closest = [0], vectors @ vectors[0]
        while len(start) < k:
            start.append(int(closest.argmin()))
            closest = np.maximum(closest, vectors @ vectors[start[-1]])
        middle = vectors[start]
        for _ in range(rounds):
            of = (vectors @ middle.T).argmax(axis=1)
            sums = np.zeros_like(middle)
            np.add.at(sums, of, vectors)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            middle = np.where(size > 0, sums / np.maximum(size, 1e-12), middle)
        # the tour: always on to the nearest one left
        like, tour, left = middle @ middle.T, [0], set(range(1, k))
        while left:
            tour.append(max(left, key=lambda j: (like[tour[-1], j], -j)))
            left.remove(tour[-1])
        self.centroids = middle[tour]

    def vectors(self, n: int, held: tuple[np.ndarray, ...], own: np.ndarray) -> np.ndarray:
        """Unit vectors of n rows over the terms (zero where a row has none), from the rows'
        words (row, code, count) and the hashes of the codes."""
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        term = np.where(self.hashes[at] == own, at, -1)[held[1]]
        known = term >= 0
        rows, term = held[0][known], term[known]
        weight = np.log1p(held[2][known]) * self.idf[term]
        size = np.sqrt(np.bincount(rows, weight * weight, minlength=n))
        out = np.zeros((n, len(self.hashes)), np.float32)
        out[rows, term] = weight / size[rows]
        return out

    def keys(self, n: int, held: tuple[np.ndarray, ...], own: np.ndarray) -> np.ndarray:
        """The tour places of each row's nearest centroids, the nearest first, as one number."""
        if not len(self.hashes):
            return np.zeros(n, np.int64)
        like = self.vectors(n, held, own) @ self.centroids.T
        like[np.arange(n), like.argmax(axis=1)] += 4  # the nearest one stays first
        nearest = np.argsort(-like, axis=1, kind="stable")[:, :NEAREST]
        out = np.zeros(n, np.int64)
        for k in range(nearest.shape[1]):
            out = (out << 8) | nearest[:, k]
        return out


def fill(lengths: np.ndarray, index: Bm25Index, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    unused = np.ones(len(lengths), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    window: list[tuple[int, int, int]] = []
    sequence, used, next_seed = 0, 0, 0
    carried: tuple[int, int] | None = None
    while True:
        if carried is None:
            while next_seed < len(lengths) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(lengths):
                break
            carried = (next_seed, 0)
            unused[next_seed] = False
        seed, start = carried
        carried = None
        while start < lengths[seed] and carried is None:
            take = min(int(lengths[seed]) - start, length - used)
            window.append((seed, start, take))
            used, start = used + take, start + take
            if used == length:
                pieces.extend(_laid(window, sequence))
                window, used, sequence = [], 0, sequence + 1
        if not used:
            continue  # the seed ended with its window
        scores = np.where(unused, index.scores(seed), -1.0)
        for row in np.argsort(-scores, kind="stable")[: int(unused.sum())]:
            unused[row] = False
            take = min(int(lengths[row]), length - used)
            window.append((int(row), 0, take))
            used += take
            if used == length:
                pieces.extend(_laid(window, sequence))
                window, used, sequence = [], 0, sequence + 1
                if take < lengths[row]:
                    carried = (int(row), take)
                break
    # the rest, in sequences of falling powers of two
    while used:
        size, part, left = 1 << (used.bit_length() - 1), [], []
        room = size
        for row, start, take in window:
            now = min(take, room)
            room -= now
            if now:
                part.append((row, start, now))
            if take > now:
                left.append((row, start + now, take - now))
        pieces.extend(_laid(part, sequence))
        window, used, sequence = left, used - size, sequence + 1
    return pieces


def _laid(window: list[tuple[int, int, int]], sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    offset = 0
    for row, start, take in window:
        yield row, start, take, sequence, offset
        offset += take


def packed(
    docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every
    piece; ids as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    if length & (length - 1):
        raise ValueError("the length must be a power of two")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size, many = rows.agg(F.sum(F.octet_length("text") + 16), F.count("*")).first()
    order = LexicalOrder([r.text for r in bounded_sample(rows.select("text"), SAMPLE_ROWS).collect()])
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    marked = checkpointed(rows.mapInArrow(lambda b: _marked(b, order), _MARKED))
    spread = word_spread(marked)
    mean = (marked.agg(F.sum("n_words")).first()[0] or 0) / max(1, many)
    idf = inverse_frequency(many, spread).astype(np.float32)

    def pack(shard: pa.Table, first: int) -> tuple[pa.RecordBatch, int]:
        found = words_of(pc.cast(shard["text"].combine_chunks(), pa.large_string()))
        ids, offsets = encoder(path).encode(found)
        lengths = np.diff(offsets) + 1
        pieces = fill(lengths, Bm25Index(found, idf[_cells(_hashes(found.words))], mean), length)
        end = np.array([end_id], "<u4").tobytes()
        raw = ids.astype("<u4").tobytes()
        out = []
        for row, start, take, _, _ in pieces:
            at = 4 * int(offsets[row] + start)
            cut = raw[at : min(at + 4 * take, 4 * int(offsets[row + 1]))]
            out.append(cut if len(cut) == 4 * take else cut + end)
        row, start, take, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        columns = [start, take, pa.array(out, pa.binary()), lengths[row], sequence + first, offset]
        doc_ids = shard["doc_id"].combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c) for c in columns)], names), first + int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        bytes_held = 0
        for batch in batches:
            for part in slices(batch, "text", shard_bytes // 4):
                held.append(part)
                bytes_held += part.nbytes
                if bytes_held >= shard_bytes:
                    out, sequence = pack(pa.Table.from_batches(held), sequence)
                    held, bytes_held = [], 0
                    yield out
        if held:
            yield pack(pa.Table.from_batches(held), sequence)[0]

    ranges = int(np.clip((size or 0) // (2 * shard_bytes), 1, RANGES))
    dealt = marked.filter("counts IS NULL").select("key", "doc_id", "text")
    dealt = dealt.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


_MARKED = "doc_id long, text string, key long, n_words long, block int, counts binary"


def _marked(batches: Iterator[pa.RecordBatch], order: LexicalOrder) -> Iterator[pa.RecordBatch]:
    """Documents with their key and length; at the end, by blocks, in how many of the task's
    documents the words of a cell are."""
    total = np.zeros(1 << CELL_BITS, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("key", pa.int64()), ("n_words", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text"):
            found = words_of(texts_of(part))
            hashes, held = _hashes(found.words), _held(found)
            total += np.bincount(_cells(hashes)[held[1]], minlength=len(total)).astype(np.uint32)
            none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(order.keys(part.num_rows, held, hashes)), pa.array(found.lengths, pa.int64()), *none], schema=schema)
    blocks = total.reshape(-1, 1 << BLOCK_BITS)
    full = np.flatnonzero(blocks.any(axis=1))
    raws = [zlib.compress(blocks[b].tobytes(), 1) for b in full]
    none = [pa.nulls(len(full), t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), pa.array(raws, pa.binary())], schema=schema)


def word_spread(marked: DataFrame) -> np.ndarray:
    """Documents with the words of a cell, over the corpus: tasks' counts are merged in two
    steps; one megabyte reaches the driver."""

    def merge(some: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for raw in some["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        packed = zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1)
        return pa.table([some["block"][:1], pa.array([0], pa.int32()), pa.array([packed], pa.binary())], ["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    counts = marked.filter("counts IS NOT NULL").select("block", F.pmod(F.spark_partition_id(), F.lit(256)).alias("part"), "counts")
    merged = counts.groupBy("block", "part").applyInArrow(merge, schema).groupBy("block").applyInArrow(merge, schema)
    total = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for row in merged.collect():
        total[row.block] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return total.ravel()
