"""Exact top-k by inner product with a pivot table (operator 3).

Vectors are turned into integers, so that scores are exact.  A bounded sample
gives the pivots; the distances of every vector to all pivots are precomputed.
For a query q and a candidate x the largest difference of their distances to
one pivot is a lower bound of |q - x|, and as 2 q.x = |q|^2 + |x|^2 - |q - x|^2
it bounds the score from above.  Candidates are evaluated in the order of that
bound until the next bound is below the k-th score found.  The sample's own
k-th score is where a query starts, which eliminates candidates at sight.

Queries and candidates meet in blocks: every block of candidates with every
block of queries, each pair in a task of bounded size; the results of the
blocks are merged by rank.

Rows with null id, and vectors that are null or hold null or non-finite
components, take no part.  A finite vector whose squared length (of its integers)
reaches 2^53 ends the query with an error that names it: its scores would not be
exact.  Extra columns do not matter.  Shorter vectors count as if filled up with zeros.
A query never meets rows of its own id; a query id that is repeated is answered
once, from the row with the smallest vector in byte order.  Ties go to the
smaller id; repeated candidate rows each count.  With fewer candidates than k,
all are returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm.textkit import checkpointed, prepare

SCALE = 1024
PIVOTS = 24
SAMPLE_ROWS = 512
CANDIDATE_BLOCK = 8_192
QUERY_BLOCK = 1_024


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector``: floor(1024 x) as little-endian 64-bit integers, for usable rows."""
    prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    if (np.floor(SCALE * x) ** 2).sum() >= 2.0**53:
                        raise ValueError(f"vector {i}: its squared length of 1024ths reaches 2^53, scores would not be exact")
                    ids.append(i)
                    out.append(np.floor(SCALE * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vector"])

    return vectors.select(id_column, vector_column).mapInArrow(run, "vec_id long, vector binary")


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Integers as doubles: sums of products are exact up to 2^53."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        x = np.frombuffer(v, "<i8")
        row[: len(x)] = x
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(query_ids: np.ndarray, queries: np.ndarray, query_far: np.ndarray, starts: np.ndarray, ids: np.ndarray, rows: np.ndarray, far: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): at least what of the k best lies in this block.  ``query_far``
    and ``far`` are rows of the pivot table, ``starts`` scores that k candidates reach."""
    out: list[tuple[int, int, int]] = []
    norms = (rows * rows).sum(axis=1)
    for q, vector, near, start in zip(query_ids, queries, query_far, starts):
        below = np.abs(far - near).max(axis=1).astype(np.float64) if far.shape[1] else np.zeros(len(rows))
        own = vector @ vector
        bound = _bound(own, norms, below)
        left = np.flatnonzero((bound >= start) & (ids != q))
        left = left[np.argsort(-bound[left], kind="stable")]
        scores, found, step = np.zeros(0), np.zeros(0, np.int64), 8 * k
        while len(left):
            now, left = left[:step], left[step:]
            scores, found = np.concatenate([scores, rows[now] @ vector]), np.concatenate([found, ids[now]])
            keep = _best(scores, found, k)
            scores, found, step = scores[keep], found[keep], step * 2
            if len(left) and len(scores) == k and bound[left[0]] < scores[-1]:
                break
        out.extend((int(q), int(i), int(s)) for i, s in zip(found, scores))
    return out


def _bound(own, norms, below):
    """Upper bound of scores from a lower bound of distances; the slack covers the rounding of
    distances, so that the bound stays above the score."""
    below = np.maximum(below - 1e-5 * (np.sqrt(own) + np.sqrt(norms) + 1), 0)
    return (own + norms - below * below) / 2 + 1


def start_score(query: int, vector: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> float:
    """The k-th score of a query in the sample: k candidates reach it."""
    first = (sample @ vector)[sample_ids != query]
    return float(np.partition(first, -k)[-k]) if len(first) >= k else -np.inf


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, vector, far, cluster``: the distances to all pivots as 32-bit floats, and the
    nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            width = max([pivots.shape[1], *(len(v) // 8 for v in raw)])
            far = _distances(_matrix(raw, width), np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))).astype("<f4")
            nearest = far.argmin(axis=1) if len(pivots) else np.zeros(len(raw), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.tobytes() for f in far], pa.binary()), pa.array(nearest, pa.int32())], ["vec_id", "vector", "far", "cluster"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector binary, far binary, cluster int")


def _far(values: list[bytes], pivots: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), pivots)


def _clusters(held: DataFrame, pivots: int, width: int) -> dict[int, tuple[int, np.ndarray, np.ndarray, float]]:
    """For each cluster its rows, the least and greatest distance to each pivot and the greatest
    squared length.  The driver gets one row for each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, far = batch.column(2).to_numpy(zero_copy_only=False), _far(batch.column(1).to_pylist(), pivots)
            x = _matrix(batch.column(0).to_pylist(), width)
            norms = (x * x).sum(axis=1)
            for c in np.unique(cluster):
                own = far[cluster == c].astype(np.float64)
                yield pa.RecordBatch.from_pydict(
                    {"cluster": [c], "n": [len(own)], "norm": [norms[cluster == c].max()], "least": [own.min(axis=0)], "most": [own.max(axis=0)]}, schema
                )

    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("norm", pa.float64()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))])
    parts = held.select("vector", "far", "cluster").mapInArrow(run, "cluster int, n long, norm double, least array<double>, most array<double>")
    sides = [f(F.col(side)[j]).alias(f"{side}{j}") for side, f in (("least", F.min), ("most", F.max)) for j in range(pivots)]
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), *sides).collect()
    return {r.cluster: (r.n, np.array([r[f"least{j}"] for j in range(pivots)]), np.array([r[f"most{j}"] for j in range(pivots)]), r.norm) for r in merged}


def open_clusters(own: float, near: np.ndarray, start: float, clusters: dict[int, tuple[int, np.ndarray, np.ndarray, float]]) -> list[int]:
    """The clusters that can hold a score of ``start`` for a query of squared length ``own`` and
    distances ``near`` to the pivots."""
    out = []
    for c, (_, least, most, norm) in clusters.items():
        below = max((least - near).max(initial=0.0), (near - most).max(initial=0.0))
        if _bound(own, norm, below) >= start:
            out.append(c)
    return out


def top_k(vectors: DataFrame, is_query: str, k: int = 10, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row of
    ``vec_id, vector`` that meets the SQL condition ``is_query``."""
    taken = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id", "vector").limit(SAMPLE_ROWS).toPandas()
    sample_ids = taken["vec_id"].to_numpy(np.int64)
    sample = _matrix([*taken["vector"]], max([0, *(len(v) // 8 for v in taken["vector"])]))
    pivots = choose_pivots(sample, PIVOTS) if len(sample) else sample
    held = checkpointed(pivot_table(vectors, pivots))
    width = (held.agg(F.max(F.length("vector"))).first()[0] or 0) // 8
    sample = np.pad(sample, ((0, 0), (0, width - sample.shape[1])))
    clusters = _clusters(held, len(pivots), width)
    blocks = {c: -(-n // candidate_block) for c, (n, *_) in clusters.items()}
    queries = held.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("vector", "far")).alias("row")).select("vec_id", "row.*")
    q_blocks = max(1, -(-queries.count() // query_block))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, cells = batch.column(0).to_numpy(), [], []
            far = _far(batch.column(2).to_pylist(), len(pivots)).astype(np.float64)
            for q, vector, near in zip(ids, _matrix(batch.column(1).to_pylist(), width), far):
                starts.append(start_score(q, vector, sample_ids, sample, k))
                cells.append([{"cluster": c, "block": b} for c in open_clusters(vector @ vector, near, starts[-1], clusters) for b in range(blocks[c])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.float64()), pa.array(cells, cell_type)], ["vec_id", "vector", "far", "start", "cells"])

    cell_type = pa.list_(pa.struct([("cluster", pa.int32()), ("block", pa.int64())]))

    def own(count: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id", "vector"), count)

    asked = queries.mapInArrow(ask, "vec_id long, vector binary, far binary, start double, cells array<struct<cluster int, block long>>")
    asked = asked.select("vec_id", "vector", "far", "start", F.explode("cells").alias("cell"), own(F.lit(q_blocks)).alias("q")).select("vec_id", "vector", "far", "start", "cell.*", "q")
    per_cluster = F.lit(1).cast("long")
    for c, n in blocks.items():
        per_cluster = F.when(F.col("cluster") == c, F.lit(n).cast("long")).otherwise(per_cluster)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q")
    copies = held.select("vec_id", "vector", "far", "cluster", own(per_cluster).alias("block"), every)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            found = search_block(
                left["vec_id"].to_numpy(), _matrix(left["vector"].to_pylist(), width), _far(left["far"].to_pylist(), len(pivots)), left["start"].to_numpy(),
                right["vec_id"].to_numpy(), _matrix(right["vector"].to_pylist(), width), _far(right["far"].to_pylist(), len(pivots)), k,
            )
        columns = [*zip(*found)] or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    cell = ["cluster", "block", "q"]
    pairs = asked.groupBy(cell).cogroup(copies.groupBy(cell)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
