"""Prefix trie of conversations (operator 12).

A node is a distinct sequence of the first d turns (role and text); its members
are the conversations that start with it.

1. Conversations are sorted by the digests of their turns, so that the members
   of a node follow each other; ids settle ties.  The sort is by ranges of
   (digests, id): neither a common first turn nor copies of one conversation
   meet in one task.
2. A task goes through its range in blocks of bounded size, each with the LCP
   (number of equal first turns) of all neighbours, those of the next block and
   the next range included.  Candidates are the prefix of each conversation that
   is its whole, and that which it shares with the one before it.  Each searches
   its left and its right extent by itself, by halving steps over a sparse table
   of LCP minima; candidates of one extent and depth are one node.  A node stands
   for the chain of depths above it which have the same members.
3. Members, children, leaves and shared words of a node are sums over its extent,
   so nodes that reach over a block's edge leave partial rows, which are added up
   by a digest of the prefix.  The ids that end in such a node come as joined
   strings, in order, and are hashed as a stream.

Turns are in the order of ``turn`` (null first), then of their digest.  Null roles
and texts are empty.  Rows without a conversation id take no part.  Repeated
rows are turns of their own.  A conversation without turns is a member of the root alone.
An empty table gives no row.  A task holds a block, or one longer
conversation (16 bytes and a word count for each turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetlog.llm.textkit import checkpointed, prepare

DIGEST = 16
BLOCK_TURNS = 1 << 18  # turns of a block, unless one conversation has more
OUT_ROWS = 1 << 16
NO_ENDS = hashlib.sha256().hexdigest()

_ROW = pa.schema(
    [
        ("block", pa.int64()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends", pa.string()),
    ]
)
_DDL = "block long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def sequences(turns: DataFrame, id_column: str = "conv_id", order_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``conv_id``, and per conversation the array ``turns`` of (hex digest, number of words), in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    one = F.struct(F.col(order_column).alias("at"), digest.alias("digest"), words.alias("words"))
    rows = turns.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("conv_id"), one.alias("one"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return ordered.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


class Block:
    """Conversations that follow each other in the sorted order, with the LCP before the
    first and after the last (-1 where there is none)."""

    def __init__(self, ids: np.ndarray, paths: list[bytes], words: list[np.ndarray], before: int, after: int):
        n = len(ids)
        self.ids, self.paths, self.n = ids, paths, n
        self.lengths = np.fromiter(map(len, paths), np.int64, n) // DIGEST
        #: words of the first d turns of conversation k: at[k] + d
        self.at = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.upto = np.zeros(self.at[-1], np.int64)
        for k, own in enumerate(words):
            np.cumsum(own, out=self.upto[self.at[k] + 1 : self.at[k + 1]])
        #: lcp[k] is between k - 1 and k, for k up to n
        self.lcp = np.array([before, *(shared(a, b) for a, b in zip(paths, paths[1:])), after], np.int64)
        inner = self.lcp[:n].copy()
        inner[0] = -1
        self.least = [inner]
        self.first_id = [ids]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            low, first = self.least[-1], self.first_id[-1]
            self.least.append(np.minimum(low[:-half], low[half:]))
            self.first_id.append(np.minimum(first[:-half], first[half:]))
        ends = self.lcp[1:] < self.lengths
        self.leaves = np.concatenate([[0], np.cumsum(ends)])
        kept = np.maximum(self.lcp[:n], 0)
        self.shared = np.concatenate([[0], np.cumsum(self.upto[self.at[:n] + kept])])
        # where the copies of conversation k end
        same = (self.lcp[1:n] == self.lengths[:-1]) & (self.lengths[1:] == self.lengths[:-1])
        last = np.append(np.flatnonzero(~same), n - 1)
        self.copies_end = last[np.searchsorted(last, np.arange(n))] + 1

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last conversation of the block that share ``depth`` turns with ``at``."""
        left, right = at.copy(), at.copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, least = 1 << k, self.least[k]
            go = np.flatnonzero(right + step < self.n)
            go = go[least[right[go] + 1] >= depth[go]]
            right[go] += step
            go = np.flatnonzero(left >= step)
            go = go[least[left[go] - step + 1] >= depth[go]]
            left[go] -= step
        return left, right

    def smallest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(self.first_id[k][left[of]], self.first_id[k][right[of] + 1 - (1 << int(k))])
        return out

    def open(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Which extents go on beyond the block."""
        return ((left == 0) & (self.lcp[0] >= depth)) | ((right == self.n - 1) & (self.lcp[self.n] >= depth))

    def nodes(self) -> tuple[np.ndarray, ...]:
        """(left, right, depth, children) of the nodes that are a whole conversation, have
        several children or are open."""
        n = self.n
        inner = np.arange(1, n)
        low, high = np.arange(self.lcp[0] + 1), np.arange(self.lcp[n] + 1)
        at = np.concatenate([np.arange(n), inner, np.zeros(len(low), np.int64), np.full(len(high), n - 1)])
        depth = np.concatenate([self.lengths, self.lcp[1:n], low, high])
        begins = np.zeros(len(at), np.int64)  # a candidate that begins a further child
        begins[n : 2 * n - 1] = self.lengths[1:] > self.lcp[1:n]
        left, right = self.extents(at, depth)
        order = np.lexsort((depth, left))
        left, right, depth, begins = left[order], right[order], depth[order], begins[order]
        head = np.ones(len(at), bool)
        head[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
        children = np.add.reduceat(begins, np.flatnonzero(head))
        left, right, depth = left[head], right[head], depth[head]
        children += (self.lengths[left] > depth) & (self.lcp[left] <= depth)
        return left, right, depth, children

    def saved(self, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of shared turns from ``depth`` on that the extents' later members repeat."""
        first = left + (self.lcp[left] < depth)  # the very first member repeats nothing
        above = np.where(depth > 0, self.upto[self.at[left] + np.maximum(depth - 1, 0)], 0)
        return self.shared[right + 1] - self.shared[first] - (right + 1 - first) * above

    def ended(self, left: np.ndarray, depth: np.ndarray) -> list[str]:
        """The ids, joined, of the members that are the prefix itself."""
        whole = self.lengths[left] == depth
        return [",".join(map(str, self.ids[a:b].tolist())) if w else "" for a, b, w in zip(left, self.copies_end[left], whole)]

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        left, right, depth, children = self.nodes()
        is_open = self.open(left, right, depth)
        yield from self._open_rows(number, left[is_open], right[is_open], depth[is_open], children[is_open])
        left, right, depth, children = (x[~is_open] for x in (left, right, depth, children))
        above = np.maximum(self.lcp[left], self.lcp[right + 1])
        ends = np.cumsum(depth - above)
        begin = 0
        while begin < len(left):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + OUT_ROWS, "right")))
            part = slice(begin, stop)
            yield self._closed_rows(number, left[part], right[part], depth[part], children[part], above[part])
            begin = stop

    def _closed_rows(self, number, left, right, depth, children, above) -> pa.RecordBatch:
        chain = depth - above
        of = np.repeat(np.arange(len(left)), chain)
        d = np.arange(chain.sum()) - np.repeat(np.cumsum(chain) - chain, chain) + above[of] + 1
        bottom = d == depth[of]
        conv = self.smallest(left, right)
        # the node above the chain
        up = np.maximum(above, 0)
        up_left, up_right = self.extents(left, up)
        away = self.open(up_left, up_right, up)
        up_conv = self.smallest(up_left, up_right)
        top = d == above[of] + 1
        no_parent = top & ((above[of] < 0) | away[of])
        keys: dict[tuple[int, int], bytes] = {}
        parent_keys: list[bytes | None] = [None] * len(of)
        for i in np.flatnonzero(top & away[of] & (above[of] >= 0)).tolist():
            k = of[i]
            place = (int(up_left[k]), int(up[k]))
            if place not in keys:
                keys[place] = prefix_keys(self.paths[place[0]], place[1], place[1])[0]
            parent_keys[i] = keys[place]
        ended = [hashlib.sha256(s.encode()).hexdigest() if s else NO_ENDS for s in self.ended(left, depth)]
        ends = [ended[k] if b else NO_ENDS for k, b in zip(of.tolist(), bottom.tolist())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(of), number)),
                pa.nulls(len(of), pa.binary()),
                pa.array(parent_keys, pa.binary()),
                pa.array(conv[of]),
                pa.array(d),
                pa.array(np.where(top, up_conv[of], conv[of]), mask=no_parent),
                pa.array((right - left + 1)[of]),
                pa.array(np.where(bottom, children[of], 1)),
                pa.array((self.leaves[right + 1] - self.leaves[left])[of]),
                pa.array(self.saved(left[of], right[of], d)),
                pa.array(ends, pa.string()),
            ],
            schema=_ROW,
        )

    def _open_rows(self, number, left, right, depth, children) -> Iterator[pa.RecordBatch]:
        if not len(left):
            return
        first, last = (prefix_keys(self.paths[k], 0, max(0, int(self.lcp[e]))) for k, e in ((0, 0), (self.n - 1, self.n)))
        of = [first if a == 0 and self.lcp[0] >= d else last for a, d in zip(left.tolist(), depth.tolist())]
        keys = [k[d] for k, d in zip(of, depth.tolist())]
        above = [k[d - 1] if d else None for k, d in zip(of, depth.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(left), number)),
                pa.array(keys, pa.binary()),
                pa.array(above, pa.binary()),
                pa.array(self.smallest(left, right)),
                pa.array(depth),
                pa.nulls(len(left), pa.int64()),
                pa.array(right - left + 1),
                pa.array(children),
                pa.array(self.leaves[right + 1] - self.leaves[left]),
                pa.array(self.saved(left, right, depth)),
                pa.array(self.ended(left, depth), pa.string()),
            ],
            schema=_ROW,
        )


def shared(a: bytes, b: bytes) -> int:
    """How many first digests two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // DIGEST


def prefix_keys(path: bytes, low: int, high: int) -> list[bytes]:
    """Digests of the first ``low``, ..., ``high`` turns of a path."""
    running = hashlib.sha256(path[: low * DIGEST])
    out = [running.digest()[:DIGEST]]
    for d in range(low, high):
        running.update(path[d * DIGEST : (d + 1) * DIGEST])
        out.append(running.digest()[:DIGEST])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], edges: dict[int, int], after: dict[int, int], block_turns: int) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    paths: list[bytes] = []
    words: list[np.ndarray] = []
    part, number, turns, before = None, 0, 0, -1

    def closed(reach: int) -> Iterator[pa.RecordBatch]:
        yield from Block(np.array(ids, np.int64), paths, words, before, reach).rows((part << 32) + number)
        ids.clear(), paths.clear(), words.clear()

    for batch in batches:
        counts = batch.column("words")
        for i, (c, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist())):
            if part is None:
                part = batch.column("part")[0].as_py()
                before = edges.get(part, -1)
            if paths and turns + len(path) // DIGEST + 1 > block_turns:
                reach = shared(paths[-1], path)
                yield from closed(reach)
                number, turns, before = number + 1, 0, reach
            ids.append(c)
            paths.append(path)
            words.append(counts[i].values.to_numpy(zero_copy_only=False))
            turns += len(path) // DIGEST + 1
    if paths:
        yield from closed(after.get(part, -1))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows, sorted by key and block, to one row a key."""
    now, ends, joined = None, None, False
    out: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["key"] != now["key"]:
                if now is not None:
                    out.append(now | {"ends": ends.hexdigest()})
                now, ends, joined = row, hashlib.sha256(), False
            else:
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[name] += row[name]
                now["conv_id"] = min(now["conv_id"], row["conv_id"])
            if row["ends"]:
                ends.update(("," if joined else "").encode() + row["ends"].encode())
                joined = True
        if len(out) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(out, _ROW)
            out = []
    if now is not None:
        out.append(now | {"ends": ends.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, _ROW)


def trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of ``conv_id, turns`` (as from ``sequences``): ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` (of the ids that end here, ascending, joined by commas)."""
    spark = prepare(conversations.sparkSession)
    flat = checkpointed(
        conversations.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        )
    )
    ordered = checkpointed(
        flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("part", F.spark_partition_id())
    )
    # one row for each range: what its first shares with the last of the range before it
    ends = ordered.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    pairs = ends.select("part", "first", *(F.lag(c).over(Window.orderBy("part")).alias(f"prev_{c}") for c in ("part", "last"))).filter("prev_part IS NOT NULL")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lcp = [shared(x, y) for x, y in zip(b.column("prev_last").to_pylist(), b.column("first").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("prev_part"), pa.array(lcp, pa.int64())], ["part", "prev_part", "lcp"])

    told = pairs.mapInArrow(reach, "part int, prev_part int, lcp long").collect()  # three numbers a range
    edges, after = {r.part: r.lcp for r in told}, {r.prev_part: r.lcp for r in told}

    rows = checkpointed(ordered.mapInArrow(lambda b: _blocks(b, edges, after, block_turns), _DDL))
    partial, closed = rows.filter("key IS NOT NULL"), rows.filter("key IS NULL")
    merged = checkpointed(partial.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_merged, _DDL))
    named = merged.select("key", F.col("conv_id").alias("of_key"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    # a block's own list of its open nodes, so that no parent meets all its children in one task
    listed = partial.select("block", "key").join(named, "key").select("block", F.col("key").alias("parent_key"), "of_key")
    found = F.coalesce("parent_conv_id", "of_key")
    inside = closed.join(listed, ["block", "parent_key"], "left").withColumn("parent_conv_id", found)
    across = merged.join(named.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", found)
    return inside.select(*columns).unionByName(across.select(*columns))
