"""Jaccard self-join of documents on word shingles (operator 2).

A document's set holds its distinct shingles of ``words`` words (the whole
sequence if it has fewer).  Sets are ordered by a total order that puts widely
shared shingles last, and the first n - ceil(t n) + 1 shingles of a set are its
prefix: sets that link share a prefix shingle.

1. Documents with one set become one member, and members with one prefix and
   size become one group.
2. Groups that share a prefix shingle are paired, by size and by what its place
   leaves possible: in blocks of the shingles' hashes, or, for a shingle of more
   than ``hot`` sets, in joins that split it.  A shingle of up to ``bucket`` groups pairs
   them all; one of more pairs each with a few that are drawn by hash.
3. Group pairs are expanded to members and verified, by bitmaps and on the full sets; a group's
   members are verified with its smallest.  Then, at each shingle of more groups, sets outside the
   component that has most of its sets are verified with some of that component.
4. What pairing through drawn ones leaves out, and what lies between the
   further members of groups, is paired in a second step, but only between
   different components of the links so far: links inside a component cannot
   change it.

So copies and families of near copies of any size cost a number of pairs in
proportion to their rows, and no link between components is missed.  The order
comes from counts of all shingles in a bounded number of cells; it decides how
many candidates there are, never which links are found.

Words are compared with A-Z in lower case.  Null texts and texts without words
have an empty set and link with nothing.  Rows with equal id and text, and
repeated rows, fall into the same component; a null id is never the smallest
unless it is alone, then the component is null.  An empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.components import connected
from fleetlog.llm.textkit import ODD, checkpointed, hash_words, mix, prepare, slices, texts_of, window_hashes, without, words_of

WORDS = 5
PERCENT = 75
BUCKET = 32
CENTRES = 8  # groups that all others of a wide token are paired with
HOT = 1 << 18  # sets that a shingle's cell counts before its entries go row by row
CELL_BLOCK_BITS = 12
BLOCK_ENTRIES = 1 << 20  # prefix entries that meet in one block, about
MIN_BLOCK_BITS = 5
PAIRS_AT_ONCE = 1 << 20
STRAY_CELLS = 32  # of a wide token's sets: one of each is met from outside their component


def _sets(part: pa.RecordBatch, words: int, column: str = "text") -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    found = words_of(pc.ascii_lower(texts_of(part, column)))
    hashes = hash_words(found.words)[found.codes] if len(found.codes) else np.zeros(0, np.uint64)
    grams, first = window_hashes(hashes, found.offsets, words)
    cut = np.searchsorted(first, found.offsets)
    for i, n in enumerate(found.lengths):
        if n >= words:
            yield np.unique(grams[cut[i] : cut[i + 1]])
        elif n:
            own = hashes[found.offsets[i] : found.offsets[i + 1]]
            whole = own * np.cumprod(np.full(n, ODD, np.uint64), dtype=np.uint64)
            yield mix(whole.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def _fold(values: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes, as a signed integer."""
    whole = mix(values + ODD).sum(dtype=np.uint64, keepdims=True)
    return int(mix(whole ^ mix(np.array([len(values)], np.uint64))).astype(np.int64)[0])


def shingle_counts(docs: DataFrame, words: int, text_column: str) -> np.ndarray:
    """Sets with a shingle, counted over all documents in cells of the shingles' hashes (a
    task counts equal sets once): one byte for each cell, four times the logarithm of its
    count.  There are about a cell for 64 words, 2^24 at most, so 16 MB go to the tasks."""
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    bits = int(np.clip(np.log2(max(1, size / 384)), CELL_BLOCK_BITS, 24))
    cells = 1 << CELL_BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                held = []
                for own in _sets(part, words):
                    if len(own) and (key := _fold(own)) not in seen:
                        seen.add(key)
                        held.append(own)
                if held:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        parts = total.reshape(-1, cells)
        full = np.flatnonzero(parts.any(axis=1))
        part = TaskContext.get().partitionId() % 256
        raws = [zlib.compress(parts[b].tobytes(), 1) for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array(raws, pa.binary())], ["block", "part", "counts"])

    def merge(some: pa.Table) -> pa.Table:
        total = np.zeros(cells, np.uint32)
        for raw in some["counts"].to_pylist():
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        return pa.table([some["block"][:1], pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "part", "counts"])

    schema = "block int, part int, counts binary"
    counted = docs.select(F.col(text_column).alias("text")).mapInArrow(count, schema)
    merged = counted.groupBy("block", "part").applyInArrow(merge, schema).groupBy("block").applyInArrow(merge, schema)
    total = np.zeros((1 << (bits - CELL_BLOCK_BITS), cells), np.uint32)
    for row in merged.collect():
        total[row.block] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return np.concatenate([(4 * np.log2(np.maximum(row, 1))).astype(np.uint8) for row in total])


def _prefix(own: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the total order, rare cells first and then by hash, and the
    counts of its shingles."""
    count = counts[(own >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)]
    order = np.argsort(count, kind="stable")[: len(own) - (percent * len(own) + 99) // 100 + 1]
    return own[order], count[order]


_ROWS = "kind int, doc_id long, key long, n long, sid long, gid long, payload binary"
_MEMBER, _BLOCK, _FREQUENT = 0, 1, 2


_ENTRY = np.dtype([("gid", "<i8"), ("n", "<u4"), ("place", "<u2"), ("high", "<u4"), ("low", "<u2")])
_LAST = 65_535  # places from here on count as this one


def _pack(tokens: np.ndarray, gids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> bytes:
    """Prefix entries of one slice and block: the group, its size, the place in the prefix
    and 48 bits of the token."""
    out = np.empty(len(tokens), _ENTRY)
    short = tokens >> np.uint64(16)
    out["gid"], out["n"], out["place"] = gids, sizes, np.minimum(places, _LAST)
    out["high"], out["low"] = short >> np.uint64(16), short & np.uint64(0xFFFF)
    return out.tobytes()


def _unpack(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(token, gid, n, place) of the entries of a block's slices."""
    entries = np.frombuffer(b"".join(raws), _ENTRY)
    token = (entries["high"].astype(np.uint64) << np.uint64(16)) | entries["low"]
    return token, entries["gid"], entries["n"], entries["place"]


def _bitmap(own: np.ndarray) -> bytes:
    """A set as bits, at least four for each shingle: the top bits of its hashes."""
    bits = max(64, 1 << int(4 * len(own) - 1).bit_length()) if len(own) else 64
    out = np.zeros(bits, np.uint8)
    out[(own >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _may_link(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Whether the bitmaps allow a link: each bit that differs is a shingle of one set alone."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):  # of the larger one, neighbouring bits fall together
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = np.packbits(np.unpackbits(b).reshape(8 * len(a), -1).any(axis=1))
    differ = int(np.bitwise_count(a ^ b).sum())
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def members(docs: DataFrame, words: int, percent: int, hot: int, id_column: str, text_column: str) -> DataFrame:
    """Rows of three kinds: ``doc_id, key, n, sid, gid`` of every document, its set and its
    group, with the set's bitmap as payload (``key`` finds the row again); the prefixes of the groups of a slice, packed by
    blocks of tokens; and, row by row, the prefix entries with tokens of so many sets that
    a block could not hold them (the token as ``key``, its place as ``sid``)."""
    counts = shingle_counts(docs, words, text_column)
    often_from = max(4 * np.log2(hot), float(np.median(counts)) + 12)  # and eight times the usual
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    # a sixth of the bytes are words, a quarter of those are in prefixes
    bits = max(MIN_BLOCK_BITS, int(np.ceil(np.log2(max(1, size / 24 / BLOCK_ENTRIES)))))

    def batch_of(kind: int, **columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        arrays = [pa.array(np.full(rows, kind), pa.int32())]
        arrays += [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(rows, pa.int64()) for c in ("doc_id", "key", "n", "sid", "gid")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns.get("payload", [None] * rows), pa.binary())], names)

    names = [f.split()[0] for f in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, sids, gids, shorts, prefixes = [], [], [], [], {}
                for own in _sets(part, words):
                    n = len(own)
                    prefix, count = _prefix(own, counts, percent)
                    sizes.append(n)
                    sids.append(_fold(own))
                    gids.append(_fold(np.append(prefix, np.uint64(n))))
                    shorts.append(_bitmap(own))
                    if n:
                        prefixes[gids[-1]] = (n, prefix, count >= often_from)
                yield batch_of(_MEMBER, doc_id=part.column(0), key=part.column(1), n=sizes, sid=sids, gid=gids, payload=shorts)
                if not prefixes:
                    continue
                groups = np.array([*prefixes], np.int64)
                sizes, lengths = (np.array(x) for x in zip(*((n, len(p)) for n, p, _ in prefixes.values())))
                sets = np.repeat(np.arange(len(groups)), lengths)
                tokens, often = (np.concatenate([x[k] for x in prefixes.values()]) for k in (1, 2))
                places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield batch_of(_FREQUENT, key=tokens[often].astype(np.int64), n=sizes[sets[often]], sid=places[often], gid=groups[sets[often]])
                # a bijection that spreads what cells and order have drawn together
                tokens, sets, places = mix(tokens[~often]), sets[~often], places[~often]
                order = np.argsort(tokens, kind="stable")
                tokens, sets, places = tokens[order], sets[order], places[order]
                edges = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                edges = np.append(edges, len(tokens))
                full = np.flatnonzero(np.diff(edges))
                cuts = [slice(edges[b], edges[b + 1]) for b in full]
                yield batch_of(_BLOCK, key=full, payload=[_pack(tokens[c], groups[sets[c]], sizes[sets[c]], places[c]) for c in cuts])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, _ROWS)


def _fit(n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow a link, and what is left of the sets from a shared token on,
    if it is the first one shared; pairs that link pass at their first one."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    sizes = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return sizes & ((100 + percent) * np.minimum(n - at, m - to) >= percent * (n + m))


def _pairs_of(raws: list[bytes], percent: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group pairs (a, b) that share a token of the block and may link; entries (token, gid,
    n, place) of tokens with more than ``bucket`` groups; and the pairs of their groups
    with a few of them, drawn by hash."""
    token, gid, n, place = _unpack(raws)
    order = np.lexsort((gid, token))
    token, gid = token[order], gid[order]
    # tokens of one group alone lead nowhere
    alone = np.ones(len(token), bool)
    alone[1:] = token[1:] != token[:-1]
    alone[:-1] &= alone[1:]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
    keep = new & ~alone
    token, gid, n, place = token[keep], gid[keep], n[order[keep]], place[order[keep]]
    starts = np.flatnonzero(np.concatenate([np.ones(int(len(token) > 0), bool), token[1:] != token[:-1]]))
    groups = np.diff(np.append(starts, len(token)))
    found = [np.zeros((0, 2), np.int64)]
    for many in np.unique(groups[(groups > 1) & (groups <= bucket)]):
        i, j = np.triu_indices(int(many), 1)
        own = starts[groups == many]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(own), step):
            a, b = (own[k : k + step, None] + i).ravel(), (own[k : k + step, None] + j).ravel()
            fits = _fit(n[a], n[b], place[a], place[b], percent)
            found.append(np.stack([gid[a[fits]], gid[b[fits]]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    stars = [np.zeros((0, 2), np.int64)]
    for start, many in zip(starts[groups > bucket], groups[groups > bucket]):
        every = np.arange(start, start + many)
        for centre in start + np.argsort(mix(gid[every].view(np.uint64)))[:CENTRES]:
            to = every[(gid[every] != gid[centre]) & _fit(n[every], n[centre], place[every], place[centre], percent)]
            stars.append(np.sort(np.stack([np.full(len(to), gid[centre]), gid[to]], axis=1), axis=1))
    star = np.unique(np.concatenate(stars), axis=0)
    entry = np.flatnonzero(np.repeat(groups > bucket, groups))
    return pairs, np.stack([token[entry].astype(np.int64), gid[entry], n[entry], place[entry]], axis=1), star


def block_pairs(rows: DataFrame, percent: int, bucket: int) -> DataFrame:
    """``kind, a, b, n, at``: pairs of groups (kind 0), pairs with the drawn groups of a wide
    token (1), and entries of wide tokens (2: token, group, size, place)."""
    names = ["kind", "a", "b", "n", "at"]

    def merge(block: pa.Table) -> pa.Table:
        pairs, wide, star = _pairs_of(block["payload"].to_pylist(), percent, bucket)
        out = np.concatenate([np.pad(np.insert(x, 0, kind, axis=1), ((0, 0), (0, 4 - x.shape[1]))) for kind, x in enumerate((pairs, star, wide))])
        return pa.table([pa.array(np.ascontiguousarray(out[:, k])) for k in range(5)], names)

    blocks = rows.filter(F.col("kind") == _BLOCK).select("key", "payload")
    return blocks.groupBy("key").applyInArrow(merge, "kind long, a long, b long, n long, at long").distinct()


def _fits(percent: int) -> str:
    """SQL: the sizes of a and b, and what is left from a shared token on, allow a link."""
    return (
        f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND "
        f"{100 + percent} * least(a.n - a.at, b.n - b.at) >= {percent} * (a.n + b.n)"
    )


def likely(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The sets of those pairs ``a, b`` whose ``bitmaps`` (``id, sid, n, bits``) allow a link."""
    both = pairs.join(bitmaps.select(F.col("id").alias("a"), F.col("sid").alias("x"), "n", F.col("bits").alias("left")), "a")
    both = both.join(bitmaps.select(F.col("id").alias("b"), F.col("sid").alias("y"), F.col("n").alias("m"), F.col("bits").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("left", "n", "right", "m"))
            keep = [_may_link(x, n, y, m, percent) for x, n, y, m in zip(*sides)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    return both.select("x", "y", "left", "n", "right", "m").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The set pairs ``a, b``, compared on their full sets: whether they ``link``, and the share
    of their union that they have in common."""
    members = rows.filter(F.col("kind") == _MEMBER)
    asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    keys = members.select("sid", "key").join(asked, "sid").groupBy("sid").agg(F.min("key").alias("key"))
    texts = docs.select(F.xxhash64(id_column, text_column).alias("key"), F.col(text_column).alias("text")).join(keys, "key").select("sid", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = pa.array([s.tobytes() for s in _sets(part, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), own], ["sid", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share = [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                keep.append(100 * both >= percent * union)
                share.append(both / union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_()), pa.array(share, pa.float64())], ["a", "b", "link", "share"])

    full = checkpointed(texts.mapInArrow(sets, "sid long, set binary").dropDuplicates(["sid"]))
    joined = pairs.join(full.select(F.col("sid").alias("a"), F.col("set").alias("left")), "a")
    joined = joined.join(full.select(F.col("sid").alias("b"), F.col("set").alias("right")), "b").select("a", "b", "left", "right")
    return checkpointed(joined.mapInArrow(compare, "a long, b long, link boolean, share double"))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``labels`` with further links."""
    if links.isEmpty():
        return labels
    return connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links.select("a", "b")))


def stray_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Set pairs ``a, b``: for each wide token of ``held`` (``token, sid, n, at, label``), the sets
    outside the component that has most of its sets, each with a few of that component.  They are drawn
    by set and token, so a set meets others at each of its tokens; of those in one of the cells, it is the one
    with the token in its earliest place, with which the sizes allow most links."""
    cell = F.pmod(F.xxhash64("sid", "token"), F.lit(STRAY_CELLS)).alias("cell")
    drawn = held.groupBy("token", "label", cell).agg(F.count("*").alias("size"), F.min(F.struct("at", "n", "sid")).alias("centre"))
    parts = drawn.groupBy("token", "label").agg(F.sum("size").alias("size"), F.collect_list("centre").alias("centres"))
    main = parts.groupBy("token").agg(F.max_by(F.struct("label", "centres"), F.struct("size", "label")).alias("main"))
    centres = main.select("token", F.col("main.label").alias("label"), F.inline("main.centres"))
    met = held.alias("a").join(centres.alias("b"), F.expr(f"a.token = b.token AND a.label <> b.label AND {_fits(percent)}"))
    return met.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))


def labels_of(rows: DataFrame, docs: DataFrame, words: int, percent: int, bucket: int, id_column: str, text_column: str) -> DataFrame:
    """``node, label`` of every linked set: the components of the rows' links."""

    def exactly(pairs: DataFrame) -> DataFrame:
        return compared(pairs, rows, docs, words, percent, id_column, text_column)

    members = rows.filter(F.col("kind") == _MEMBER).filter("n > 0")
    of_sets = members.select(F.col("sid").alias("id"), "sid", "n", F.col("payload").alias("bits")).dropDuplicates(["id"])
    sets = rows.filter(F.col("kind") == _MEMBER).filter("n > 0").select("sid", "gid", "n").distinct()
    groups = checkpointed(sets.groupBy("gid").agg(F.min("sid").alias("first"), F.count("*").alias("members"), F.min("n").alias("n")))
    # rare tokens meet in blocks
    blocks = checkpointed(block_pairs(rows, percent, bucket))
    near, star, wide = (blocks.filter(F.col("kind") == kind) for kind in range(3))
    near, star = near.select("a", "b"), star.select("a", "b")
    wide = wide.select(F.col("a").alias("token"), F.col("b").alias("gid"), "n", "at")
    # frequent ones, of which any may be on a third of all rows, in joins that split them
    frequent = rows.filter(F.col("kind") == _FREQUENT)
    if not frequent.isEmpty():
        often = frequent.select(F.col("key").alias("token"), "gid", "n", F.col("sid").alias("at")).distinct()
        drawn = [F.min_by("gid", F.xxhash64("gid", F.lit(k))) for k in range(CENTRES)]
        counted = often.groupBy("token").agg(F.count("*").alias("size"), F.array(*drawn).alias("centres"))
        broad = checkpointed(counted.filter(F.col("size") > bucket))
        narrow = often.join(broad, "token", "left_anti")
        wide = often.join(broad, "token", "left_semi").unionByName(wide)
        meet = narrow.alias("a").join(narrow.alias("b"), F.expr(f"a.token = b.token AND a.gid < b.gid AND {_fits(percent)}"))
        near = meet.select(F.col("a.gid").alias("a"), F.col("b.gid").alias("b")).unionByName(near)
        centres = broad.select("token", F.explode(F.array_distinct("centres")).alias("centre"))
        centres = centres.join(groups.select(F.col("gid").alias("centre"), F.col("n").alias("m")), "centre").select("token", "centre", "m")
        meet = often.join(centres, "token").filter(f"gid <> centre AND 100 * least(n, m) >= {percent} * greatest(n, m)")
        star = meet.select(F.col("gid").alias("a"), F.col("centre").alias("b")).unionByName(star)
    close, star = _ordered_pairs(near), _ordered_pairs(star)
    # a group stands for its first member, whose bitmap rules most pairs out
    first = groups.select("gid", F.col("first").alias("sid"))
    of_groups = members.join(first, ["gid", "sid"], "left_semi").select(F.col("gid").alias("id"), "sid", "n", F.col("payload").alias("bits")).dropDuplicates(["id"])

    several = checkpointed(sets.select("sid", "gid").join(groups.filter("members > 1"), "gid"))
    within = several.select(F.col("sid").alias("a"), F.col("first").alias("b")).filter("a <> b")
    pairs = close.unionByName(star).unionByName(within).distinct()  # hashes of groups and of sets: ids of one table
    scored = exactly(_ordered_pairs(likely(pairs, of_groups.unionByName(of_sets), percent)))
    labels = connected(scored.filter("link"))

    def known_by(labels: DataFrame) -> DataFrame:
        lone = F.coalesce("label", "sid").alias("label")
        return sets.select("sid", "gid").join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "gid", lone)

    def held_by(labels: DataFrame) -> DataFrame:
        return checkpointed(wide.join(known_by(labels).withColumnRenamed("gid", "of"), F.expr("gid = of")).drop("of"))

    # a family's sets that met none of their own by the drawn groups meet others of it
    held = None if wide.isEmpty() else held_by(labels)
    if held:
        strays = checkpointed(likely(_ordered_pairs(stray_pairs(held, percent)), of_sets, percent))
        if not strays.isEmpty():
            labels = joined_by(labels, exactly(strays).filter("link"))
            held = held_by(labels)

    # second step: all that is left, between components only, as links inside one cannot change it
    apart = "a.sid <> b.sid AND a.label <> b.label"

    def expand(group_pairs: DataFrame) -> DataFrame:
        known = checkpointed(known_by(labels))
        ends = group_pairs.alias("p").join(known.alias("a"), F.expr("p.a = a.gid")).join(known.alias("b"), F.expr(f"p.b = b.gid AND {apart}"))
        return ends.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))

    rest = None
    if not several.isEmpty():
        more = several.select("gid").distinct()
        same = more.select(F.col("gid").alias("a"), F.col("gid").alias("b"))
        either = close.join(more, close["a"] == more["gid"], "left_semi").unionByName(close.join(more, close["b"] == more["gid"], "left_semi"))
        rest = expand(either.unionByName(same))
    if held:
        pair = held.alias("a").join(held.alias("b"), F.expr(f"a.token = b.token AND a.gid < b.gid AND a.label <> b.label AND {_fits(percent)}"))
        pair = pair.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))
        rest = pair if rest is None else rest.unionByName(pair)
    if rest is None:
        return labels
    left = checkpointed(likely(_ordered_pairs(rest), of_sets, percent))
    return labels if left.isEmpty() else joined_by(labels, exactly(left).filter("link"))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET, hot: int = HOT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, key, n_shingles, class, component_id`` of every row; ``key`` is
    ``xxhash64(id, text)``, by which rows find their component, and ``class`` is
    one number for each component, null for empty sets."""
    prepare(docs.sparkSession)
    rows = checkpointed(members(docs, words, percent, hot, id_column, text_column))
    found = labels_of(rows, docs, words, percent, bucket, id_column, text_column)
    rows = rows.filter(F.col("kind") == _MEMBER).select("doc_id", "key", "n", "sid")
    own = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("smallest")).join(found.withColumnRenamed("node", "sid"), "sid", "left")
    own = own.select("sid", "smallest", F.coalesce("label", "sid").alias("label"))
    classes = own.groupBy("label").agg(F.min("smallest").alias("component_id"))
    out = rows.join(own.join(classes, "label").select("sid", "label", "component_id"), "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("label").alias("class"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id, and all
    rows with empty sets; a column ``_key`` in ``docs`` gives way."""
    docs = without(docs, "_key")
    has_word = F.coalesce(F.col(text_column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **options).filter("n_shingles > 0")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    keys = first.select(F.col("first.key").alias("_key"))
    kept = docs.filter(has_word).withColumn("_key", F.xxhash64(id_column, text_column)).join(keys, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).drop("_key").unionByName(docs.filter(~has_word))
