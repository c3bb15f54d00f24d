"""Ordered-sequence building blocks that survive a giant key.

A window ``partitionBy(vehicle)`` puts a whole vehicle in one task.  Every
ordered operator here instead partitions by ``(keys, time bucket)``: the
in-bucket part is an ordinary window over a small group, and whatever a row
needs from earlier (or later) buckets is *carried* from a per-bucket summary
table (one row per key and non-empty bucket) by a window over that small
table and an equi-join on ``(keys, bucket)``.  The large side is shuffled
once; AQE broadcasts the carry table while it is small.

Every operator follows one total order: time, row number, the values that it
carries, and last a hash of the whole row.  So rows that repeat a time and a
row number have one order too, however the input is partitioned or sorted,
and only rows that are equal throughout can be exchanged.  A summary takes
the least or greatest row of a bucket as one struct in that order
(``ordered_struct``), payload included: the window inside a bucket and the
carry between buckets agree, and carried fields always come from one row.
Summaries read the operator's *input* only, so no branch of the plan re-runs
the ordered work.

With ``keys=[]`` (the single-vehicle case of the original tool) the same
plans apply; only the tiny bucket table is ordered globally.  Null keys are a
key of their own in every operator here (``key_id``).
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.functions.text import epoch_micros
from fleetlog.schema import ROW, TS

BUCKET = "_bucket"
DEFAULT_BUCKET = "1 day"

_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
          "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}


def bucket_micros(bucket: str | timedelta | int) -> int:
    """Bucket width in microseconds from ``"6 hours"``, a timedelta or an int."""
    if isinstance(bucket, int):
        return bucket
    if isinstance(bucket, timedelta):
        return bucket // timedelta(microseconds=1)
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", bucket.lower())
    if not m or m.group(2) not in _UNITS:
        raise ValueError(f"bad bucket width: {bucket!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def bucket_of(ts: str = TS, bucket=DEFAULT_BUCKET) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(bucket_micros(bucket)))


def with_bucket(df: DataFrame, ts: str = TS, bucket=DEFAULT_BUCKET) -> DataFrame:
    if BUCKET in df.columns:
        return df
    return df.withColumn(BUCKET, bucket_of(ts, bucket))


def ordered_struct(df: DataFrame, values: dict[str, Column], ts: str = TS, row: str | None = ROW) -> Column:
    """Struct that sorts like the total order: ``_t`` (microseconds), ``_n`` (row number, null
    first), the ``values`` by name, and ``_h``, a hash of all columns of ``df``."""
    hashed = [_q(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    number = [F.col(row).cast("long").alias("_n")] if row else []
    return F.struct(epoch_micros(ts).alias("_t"), *number, *[c.alias(n) for n, c in values.items()],
                    F.xxhash64(*hashed).alias("_h"))


def key_id(keys: list[str]) -> Column:
    """All keys as one column that is never null, so that null keys are a key of
    their own under plain equality: windows, aggregates and joins on it share one
    partitioning (a null-safe join would hash other expressions and shuffle again)."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))


def previous_row(df: DataFrame, keys: list[str], payload: dict[str, Column], out: str,
                 ts: str = TS, row: str | None = ROW, bucket=DEFAULT_BUCKET,
                 ties: list[str] = (), position: str | None = None) -> DataFrame:
    """Add ``out`` = struct of ``payload`` (name -> orderable column) from the previous
    row in the order of time, row, ``ties``, payload and row hash.

    Null on each key's first row.  Equivalent to ``lag(struct(payload))`` over
    ``partitionBy(keys)`` in that order without the one-task-per-key limit.
    ``position`` names a column that numbers the rows of a (keys, bucket), which
    identifies a row even where times and row numbers repeat.
    """
    names = list(payload)
    d = with_bucket(df, ts, bucket).withColumn("_kid", key_id(keys))
    values = {f"_tie{i}": F.col(c) for i, c in enumerate(ties)} | dict(payload)
    d = d.withColumn("_o", ordered_struct(df, values, ts, row))
    carried = F.struct(*[F.col("_o")[n].alias(n) for n in names])
    last = d.groupBy("_kid", BUCKET).agg(F.max("_o").alias("_o")).select("_kid", BUCKET, carried.alias("_last"))
    carry = last.select("_kid", BUCKET, F.lag("_last").over(Window.partitionBy("_kid").orderBy(BUCKET)).alias("_carry"))
    in_bucket = Window.partitionBy("_kid", BUCKET).orderBy("_o")
    found = d.join(carry, ["_kid", BUCKET], "left").withColumn(out, F.coalesce(F.lag(carried).over(in_bucket), F.col("_carry")))
    if position:
        found = found.withColumn(position, F.row_number().over(in_bucket))
    return found.drop("_o", "_carry", "_kid")


def running_total(df: DataFrame, keys: list[str], value: Column, out: str,
                  ts: str = TS, row: str | None = ROW, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Add ``out`` = cumulative sum of ``value`` in the total order per key (rows frame)."""
    d = with_bucket(df, ts, bucket).withColumn("_x", value).withColumn("_kid", key_id(keys))
    d = d.withColumn("_o", ordered_struct(df, {"_x": F.col("_x")}, ts, row))
    totals = d.groupBy("_kid", BUCKET).agg(F.sum("_x").alias("_tot"))
    before = Window.partitionBy("_kid").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_kid", BUCKET, F.sum("_tot").over(before).alias("_carry"))
    upto = Window.partitionBy("_kid", BUCKET).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(d.schema["_x"].dataType)
    return (d.join(carry, ["_kid", BUCKET], "left")
            .withColumn(out, F.sum("_x").over(upto) + F.coalesce("_carry", zero))
            .drop("_x", "_o", "_carry", "_kid"))


def first_value(df: DataFrame, keys: list[str], value: str, out: str,
                ts: str = TS, row: str | None = ROW, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Add ``out`` = ``value`` of each key's first row in the total order, carried to
    the key's buckets so that a key's rows never meet in one task."""
    d = with_bucket(df, ts, bucket).withColumn("_kid", key_id(keys))
    number = [F.col(row).cast("long")] if row else []
    heads = d.groupBy("_kid", BUCKET).agg(F.min(F.struct(epoch_micros(ts), *number, F.col(value).alias("_head")))["_head"].alias("_head"))
    of_key = Window.partitionBy("_kid").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    carry = heads.select("_kid", BUCKET, F.first("_head").over(of_key).alias(out))
    return d.join(carry, ["_kid", BUCKET]).drop("_kid")


def first_and_last(value: str, ts: str = TS, row: str | None = ROW, when: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: ``value`` of the first and of the last row (``when`` it holds) in the total order."""
    number = [F.col(row).cast("long")] if row else []
    o = F.struct(epoch_micros(ts), *number, F.col(value).alias("_v"))
    o = o if when is None else F.when(when, o)
    return F.min(o)["_v"], F.max(o)["_v"]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def asof_neighbours(probes: DataFrame, readings: DataFrame, keys: list[str], value: str,
                    ts: str = TS, row: str = ROW, bucket=DEFAULT_BUCKET,
                    probe_buckets: DataFrame | None = None) -> DataFrame:
    """For each probe row, the nearest readings strictly before / after and at the same instant.

    Adds struct columns ``_before`` (last reading with ts < t; ties -> highest row),
    ``_exact`` (first reading with ts = t) and ``_after`` (first reading with ts > t;
    ties -> lowest row; only set when there is no exact reading, which is the only
    case that needs it), each ``(_t, _n, km, ts)``, plus ``_bucket``.  Readings that
    agree in time and row are taken in the order of their value.

    Plan: probes and readings are unioned, each column by name, and shuffled once by
    ``(keys, bucket)``; two ``last(ignore nulls)`` row windows (one ascending, one
    descending; incremental frames) find the in-bucket neighbours; neighbours in
    other buckets come from a per-bucket summary of the readings (least and greatest
    reading as one struct) carried by windows over that small table and joined on the
    same partitioning.  ``probe_buckets`` (keys + ``ts``) may stand in for ``probes``
    when listing probe buckets -- pass the cheap scanned input the probes came from,
    so the summary never re-runs their plan.

    Written as one SQL statement over the three inputs: Spark parses and analyses
    it once instead of once per DataFrame step.
    """
    spark = probes.sparkSession
    b = bucket_micros(bucket)
    kid = f"named_struct({', '.join(f'{x!r}, {_q(x)}' for x in keys)})" if keys else "named_struct('_all', 0)"
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"
    columns = probes.columns
    types = {f.name: f.dataType.simpleString() for f in probes.schema.fields}
    probe_sel = ", ".join(_q(c) for c in columns)
    # the readings in the probes' column order
    read_sel = ", ".join(_q(c) if c in keys else f"event_ts AS {_q(c)}" if c == ts else f"CAST(NULL AS {types[c]}) AS {_q(c)}"
                         for c in columns)
    key_sel = "".join(f"{_q(x)}, " for x in keys)
    reading_t = "STRUCT<_t: BIGINT, _n: BIGINT, km: DOUBLE, ts: TIMESTAMP_NTZ>"

    query = f"""
WITH rd AS (
  SELECT *, floor(_r._t / {b}) AS _bucket
  FROM (SELECT {key_sel}{kid} AS _kid, {_q(ts)} AS event_ts,
               named_struct('_t', {us.format(_q(ts))}, '_n', CAST({_q(row)} AS BIGINT), 'km', CAST({_q(value)} AS DOUBLE),
                            'ts', {_q(ts)}) AS _r
        FROM {{readings}})),
summary AS (
  SELECT _kid, _bucket, min(_r) AS _first, max(_r) AS _last
  FROM (SELECT _kid, _bucket, _r FROM rd
        UNION ALL
        SELECT {kid}, floor({us.format(_q(ts))} / {b}), CAST(NULL AS {reading_t})
        FROM {{bucket_src}})
  GROUP BY _kid, _bucket),
carry AS (
  SELECT _kid, _bucket, max(_last) OVER w_up AS _prev_last, min(_first) OVER w_down AS _next_first
  FROM summary
  WINDOW w_up AS (PARTITION BY _kid ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w_down AS (PARTITION BY _kid ORDER BY _bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
events AS (
  SELECT {probe_sel}, {kid} AS _kid, floor({us.format(_q(ts))} / {b}) AS _bucket,
         CAST(NULL AS {reading_t}) AS _r, true AS _probe
  FROM {{probes}}
  UNION ALL
  SELECT {read_sel}, _kid, _bucket, _r, false
  FROM rd),
joined AS (
  SELECT e.*, c._prev_last, c._next_first, {us.format('e.' + _q(ts))} AS _tq, e._r._n AS _rn, e._r.km AS _rkm
  FROM events e LEFT JOIN carry c ON e._kid = c._kid AND e._bucket = c._bucket),
aligned AS (
  SELECT *,
         -- last reading strictly before: probes sort before readings of the same instant
         coalesce(last(_r, true) OVER (PARTITION BY _kid, _bucket ORDER BY _tq, _probe DESC, _rn, _rkm
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), _prev_last) AS _before,
         -- first reading at or after: descending, readings before probes of the same instant
         coalesce(last(_r, true) OVER (PARTITION BY _kid, _bucket ORDER BY _tq DESC, _probe, _rn DESC, _rkm DESC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), _next_first) AS _ge
  FROM joined)
SELECT {probe_sel}, _bucket, _before,
       CASE WHEN _ge.ts > {_q(ts)} THEN _ge END AS _after,
       CASE WHEN _ge.ts = {_q(ts)} THEN _ge END AS _exact,
       _probe
FROM aligned"""
    out = spark.sql(query, readings=readings, probes=probes,
                    bucket_src=probes if probe_buckets is None else probe_buckets)
    return out.filter("_probe").drop("_probe")
