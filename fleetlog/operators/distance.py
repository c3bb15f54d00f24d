"""Odometer-only series.

First/last reading per key or month is an aggregate (least and greatest
``(time, row, km)`` struct), so it is partially aggregated per task and has
no per-key task limit; of readings that repeat a time and row number the
smallest is the first and the greatest the last.  Deltas between consecutive readings use
``sequence.previous_row`` (time-bucketed lag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period, month_start
from fleetlog.operators.sequence import DEFAULT_BUCKET, first_and_last, first_value, previous_row
from fleetlog.schema import KEY, ROW, TS


def _keys(keys):
    return [KEY] if keys is None else list(keys)


def _driven():
    first, last = first_and_last("odometer_km")
    return last - first


def total_distance(odo: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last minus first reading in time order (may be negative); < 2 readings -> 0.0."""
    k = _keys(keys)
    return (odo.groupBy(*k).agg(F.count(F.lit(1)).alias("readings"),
                                _driven().alias("_d"))
            .select(*k, "readings", F.when(F.col("readings") < 2, F.lit(0.0)).otherwise(F.col("_d"))
                    .alias("total_km")))


def monthly_km_driven(odo: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per calendar month with readings: last - first reading, one reading -> 0.0.
    Label = month start; months without readings are absent (W3)."""
    k = _keys(keys)
    return (odo.groupBy(*k, month_start(TS).alias("month"))
            .agg(F.count(F.lit(1)).alias("_n"),
                 _driven().alias("_d"))
            .select(*k, "month", F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_d")).alias("km_driven")))


def cumulative_distance(odo: DataFrame, keys: list[str] | None = None, bucket=DEFAULT_BUCKET) -> DataFrame:
    """Each reading minus the key's first reading (W2); null keys are a key of their own."""
    k = _keys(keys)
    d = first_value(odo, k, "odometer_km", "_first", bucket=bucket)
    return d.select(*k, TS, ROW, (F.col("odometer_km") - F.col("_first")).alias("cumulative_km"))


def with_delta(odo: DataFrame, keys: list[str] | None = None, out: str = "km_since_last_entry",
               bucket=DEFAULT_BUCKET) -> DataFrame:
    """Adds ``out`` = km minus the previous reading's km over the full log."""
    k = _keys(keys)
    d = previous_row(odo, k, {"km": F.col("odometer_km")}, "_prev", bucket=bucket)
    return d.withColumn(out, F.col("odometer_km") - F.col("_prev.km")).drop("_prev", "_bucket")


def distance_timeline(odo: DataFrame, period: Period, keys: list[str] | None = None,
                      bucket=DEFAULT_BUCKET) -> DataFrame:
    """Readings in the period with a non-null delta; the delta is taken over the
    full log *before* the period filter (W5, P8)."""
    k = _keys(keys)
    return (with_delta(odo, k, bucket=bucket)
            .filter(period.contains(TS) & F.col("km_since_last_entry").isNotNull())
            .select(*k, TS, ROW, "km_since_last_entry"))


def odometer_readings_in_period(odo: DataFrame, period: Period, keys: list[str] | None = None,
                                bucket=DEFAULT_BUCKET) -> DataFrame:
    """Readings in the period with the delta to the previous reading, nulls kept."""
    k = _keys(keys)
    return (with_delta(odo, k, "km_since_previous", bucket=bucket).filter(period.contains(TS))
            .select(*k, TS, ROW, "odometer_km", "km_since_previous"))
