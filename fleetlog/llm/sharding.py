"""Shards by proportional stratified interleaving (operator 13).

Rows are shuffled by a seeded hash within their stratum (source).  The row of rank
r in a stratum of n rows has the fractional rank (r + u) / n, where u in [0, 1) is the
stratum's own seeded phase; in the order of fractional ranks every stretch
holds each stratum in proportion, within one row.  The order is cut into shards
whose row counts differ by at most one.

No stratum is ever ordered in one task: hashes and fractional ranks are uniform, so both
orders are cut into buckets of about sqrt(rows) rows, numbered inside a bucket and shifted
by the bucket's place, which comes from counts of buckets.  A row's place depends on the
table's content alone, never on partitions, so lost tasks are repeated alike.

Rows with a null stratum are a stratum.  Rows with equal identity columns are
ordered by all ``ties``; rows equal in those too may be exchanged with one another.  An empty
table gives no row.  Shards beyond the number of rows stay empty.  Columns
called ``shard`` or ``slot`` or starting with ``_shard_`` give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlog.llm.textkit import without

SEED = 17
_UNIT = 16**13


def seeded(seed: int, *columns: str | Column) -> Column:
    """A seeded hash of the columns as 13 hex digits, written as a number."""
    texts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\\N")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), 1, 13), 16, 10).cast("long")


def interleaved(rows: DataFrame, shards: int, strata: str = "source", identity: list[str] = ("doc_id",), ties: list[str] = (), seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (its place in the shard, from 0).
    ``identity`` columns make the shuffle, ``ties`` settle rows equal in them."""
    rows = without(rows, "shard", "slot", *(c for c in rows.columns if c.startswith("_shard_")))
    total = rows.count()
    buckets = max(1, math.isqrt(total))
    at = F.floor(F.col("_shard_hash") * F.lit(buckets) / F.lit(float(_UNIT))).cast("long")
    keyed = rows.withColumn("_shard_of", F.struct(F.col(strata))).withColumn("_shard_hash", seeded(seed, *identity)).withColumn("_shard_bucket", at)
    # rank in the stratum
    counts = keyed.groupBy("_shard_of", "_shard_bucket").agg(F.count(F.lit(1)).alias("_shard_many"))
    stratum = Window.partitionBy("_shard_of")
    places = counts.select(
        "_shard_of",
        "_shard_bucket",
        (F.sum("_shard_many").over(stratum.orderBy("_shard_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_shard_many")).alias("_shard_before"),
        F.sum("_shard_many").over(stratum).alias("_shard_size"),
    )
    inside = Window.partitionBy("_shard_of", "_shard_bucket").orderBy("_shard_hash", *identity, *ties)
    ranked = keyed.withColumn("_shard_rank", F.row_number().over(inside)).join(places, ["_shard_of", "_shard_bucket"])
    rank = F.col("_shard_before") + F.col("_shard_rank") - 1
    phase = seeded(seed, strata) / F.lit(float(_UNIT))
    fraction = (rank + phase) / F.col("_shard_size")
    placed = ranked.withColumn("_shard_fraction", fraction).withColumn("_shard_rank", rank)
    placed = placed.withColumn("_shard_bucket", F.least(F.floor(F.col("_shard_fraction") * buckets), F.lit(buckets - 1)).cast("long"))
    # place in the order of all rows: a bucket's place follows from the strata's sizes
    slots = Window.partitionBy("_shard_bucket")
    many = placed.groupBy("_shard_bucket").agg(F.count(F.lit(1)).alias("_shard_many"))
    before = F.sum("_shard_many").over(Window.orderBy("_shard_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_shard_many")
    numbered = placed.withColumn("_shard_in", F.row_number().over(slots.orderBy("_shard_fraction", "_shard_of", "_shard_rank")))
    numbered = numbered.join(many.select("_shard_bucket", before.alias("_shard_first")), "_shard_bucket")
    place = F.col("_shard_first") + F.col("_shard_in") - 1
    numbered = numbered.withColumn("_shard_place", place)
    return (
        numbered.withColumn("shard", F.expr(f"CAST(_shard_place * {shards} div {max(1, total)} AS INT)"))
        .withColumn("slot", F.expr(f"_shard_place - (CAST(shard AS BIGINT) * {total} + {shards - 1}) div {shards}"))
        .select(*rows.columns, "shard", "slot")
    )


def written(rows: DataFrame, path: str, shards: int, **options) -> None:
    """The shards as Parquet files under ``path``, one folder a shard; a shard's files, by
    name, hold its rows in the order of ``slot``.  Ranges of (shard, slot) are written,
    so a shard may be as many tasks as its size needs."""
    dealt = interleaved(rows, shards, **options)
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
