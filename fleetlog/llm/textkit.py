"""Vectorised text helpers that run inside Arrow tasks, and session set-up.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` everywhere.  Texts are
handled in slices of a few megabytes, so that the memory of a task depends on
the slice size and on the longest single text, not on the partition.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)  # multiplier of the polynomial hash
_INV = np.uint64(pow(int(ODD), -1, 1 << 64))


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers import this package and keep Arrow batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a
    private one is made only where none is set and there is one machine."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="fleetlog-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that bear names which an operator gives to its own."""
    return df.drop(*names)


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different rows of ``df``, the first in the order of a
    hash of all columns.  Only hashes are sorted, so what reaches the driver on
    the way is 8 bytes a row."""
    keyed = without(df, "_key").withColumn("_key", F.xxhash64(*df.columns))
    # of a large table only the smallest hashes, some times as many as asked for, are sorted
    share = min(1.0, 16 * rows / max(1, df.count()))
    first = keyed.filter(F.col("_key") < int(min(2**63 - 1, -(2**63) + share * 2**64))).select("_key").distinct().orderBy("_key").limit(rows)
    return keyed.join(F.broadcast(first), "_key").dropDuplicates(["_key"]).orderBy("_key").drop("_key")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts add up to about ``limit`` bytes (a single
    longer text makes a slice of its own)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers live on and share the executor's memory


class Words(NamedTuple):
    """Row r has the words ``words[codes[offsets[r]:offsets[r + 1]]]``."""

    offsets: np.ndarray
    codes: np.ndarray
    words: pa.Array

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths)


def _coded(pieces: pa.Array, drop: str | None) -> Words:
    starts = pieces.offsets.to_numpy().astype(np.int64)
    values = pieces.values.slice(starts[0], starts[-1] - starts[0])
    starts -= starts[0]
    encoded = values.dictionary_encode()
    codes, words = encoded.indices.to_numpy(), encoded.dictionary
    if drop is not None and len(words) and (at := pc.index(words, drop).as_py()) >= 0:
        keep = codes != at
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return Words(starts, codes, words)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty, copied to buffers of their own: some kernels
    misread what a slice's cast leaves."""
    texts = batch.column(column)
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


def words_of(texts: pa.Array) -> Words:
    return _coded(pc.ascii_split_whitespace(texts), "")


def lines_of(texts: pa.Array) -> Words:
    """The pieces between ``\\n``, empty ones included."""
    return _coded(pc.split_pattern(texts, "\n"), None)


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every ``width`` consecutive words inside one row, and
    the index of each window's first word.  Equal word sequences hash alike
    wherever they stand."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    steps = np.full(n + 1, ODD, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)])
    back = np.full(n, _INV, np.uint64)
    back[0] = 1
    found = (sums[width:] - sums[:-width]) * np.cumprod(back, dtype=np.uint64)[: n - width + 1]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    first = np.flatnonzero(np.arange(n - width + 1) + width <= ends[: n - width + 1])
    return mix(found[first]), first


def repeated(keys: np.ndarray, bits: int = 22) -> np.ndarray:
    """Which of the 64-bit keys occur at least twice."""
    cells = (keys >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cells, minlength=1 << bits)[cells] > 1)
    out = np.zeros(len(keys), bool)
    if len(maybe):
        order = maybe[np.argsort(keys[maybe], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def byte_grams(words: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, word index) for the byte n-grams of `` word `` (framed by a blank
    on both sides); a gram packs its size and bytes exactly (sizes up to 7)."""
    blank = pa.scalar(" ", pa.large_string())
    framed = pc.binary_join_element_wise(blank, words.cast(pa.large_string()), blank, pa.scalar("", pa.large_string()))
    lengths = pc.binary_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.frombuffer(b"".join(framed.cast(pa.large_binary()).to_pylist()), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    grams, owners = [], []
    for n in sizes:
        if len(joined) < n:
            continue
        packed = np.full(len(joined) - n + 1, n, np.uint64)
        for k in range(n):
            packed = (packed << np.uint64(8)) | joined[k : len(joined) - n + 1 + k]
        inside = owner[: len(packed)] == owner[n - 1 :]
        grams.append(packed[inside])
        owners.append(owner[: len(packed)][inside])
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)


