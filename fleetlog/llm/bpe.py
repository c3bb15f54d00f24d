"""Byte-pair encoding and decoding of whole texts (operator 6).

A vocabulary file gives pieces and ranked merges.  A text is cut at its
special strings, normalised and split into words; each word becomes a doubly
linked list of byte symbols, and a priority queue of (rank, position) joins
the best-ranked neighbours until none is left.  An entry whose symbols have
changed since it was pushed is stale and is skipped.  Decoding joins the
vocabulary strings of the ids by one blank, as the library does for a file
without a decoder.

Encoding never crosses white space, so the ids of a text are those of its
white-space-separated chunks in order; chunks are remembered in a cache of
bounded size.  Null texts count as empty and give no id; a text of any length
is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from fleetlog.llm.textkit import prepare

#: Chunks of these characters alone are normalised by lower case; none composes with another.
PLAIN = "(?:(?!<\\|)[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e])*"
CACHE_ENTRIES = 300_000  # of chunks, and as many of words, in each worker


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for a vocabulary file with word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["decoder"] or model["byte_fallback"] or model["ignore_merges"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a word-end vocabulary without decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.strings[i] = piece
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.strings[i] = piece
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the same for lower-case ASCII, which the standard module matches faster
        self.plain_words = re.compile(self.words.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.stand_ins = _byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(self.stand_ins)}
        self.latin = re.compile(PLAIN)
        self.library = Tokenizer.from_file(path)
        self.inner = [vocab[s] for s in self.stand_ins]
        self.final = [vocab[s + end] for s in self.stand_ins]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.known_words: dict[str, tuple[int, ...]] = {}
        self.known_chunks: dict[bytes, bytes] = {}

    def symbols(self, word: str) -> str:
        """The word as the vocabulary writes its bytes."""
        return word if word.isascii() and word.isalnum() else "".join(map(self.stand_ins.__getitem__, word.encode()))

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n, merges = len(ids), self.merges
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((joined, ids[k])):
                    heapq.heappush(queue, (m[0], i, joined, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], joined))):
                heapq.heappush(queue, (m[0], h, ids[h], joined, m[1]))
        return tuple(i for i in ids if i >= 0)

    def parts(self, text: str) -> Iterator[str | int]:
        """Words, and the ids of special strings, of a text without white space."""
        if text.isascii() and "<|" not in text:
            yield from self.plain_words.findall(text.lower())
            return
        if self.latin.fullmatch(text):
            yield from self.words.findall(text.lower())
            return
        # the library's own Unicode tables, newer than Python's, for all else
        for part in self.cut.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield bytes(map(self.byte_of.__getitem__, word)).decode()

    def chunk(self, chunk: bytes) -> bytes:
        """The ids, as little-endian 32-bit integers, of a text without white space."""
        out: list[int] = []
        for word in self.parts(chunk.decode()):
            if isinstance(word, int):
                out.append(word)
                continue
            ids = self.known_words.get(word)
            if ids is None:
                if len(self.known_words) >= CACHE_ENTRIES:
                    self.known_words.clear()
                self.known_words[word] = ids = self.merge(word)
            out.extend(ids)
        return struct.pack(f"<{len(out)}I", *out)

    def encode_bytes(self, text: str | None) -> bytes:
        known, out = self.known_chunks, []
        for piece in (text or "").encode().split():
            ids = known.get(piece)
            if ids is None:
                ids = self.chunk(piece)
                if len(piece) <= 64:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@cache
def codec(path: str) -> BpeCodec:
    """One codec for each file and worker."""
    return BpeCodec(path)


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids binary`` of every row: ids as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path)
            ids = [own.encode_bytes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["id", "ids"])

    return docs.select(id_column, text_column).mapInArrow(run, "id long, ids binary")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Rows are independent: repeated rows give repeated results, a null id stays
    null, an empty table gives no row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codec(path)
            count, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode_bytes(text)
                count.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_column, text_column).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
