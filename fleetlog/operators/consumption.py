"""Fuel consumption between consecutive refuels.

For every fuel event the odometer is estimated at its timestamp (as-of +
interpolation); each event is paired with the previous event of the same
vehicle; the pair is kept when both odometer estimates are usable and the
distance is positive.  A dropped pair's later event still serves as the
predecessor of the next one.  Litres and cost belong to the *current* event.

Plan: the pairing runs on the fuel log alone (bucketed lag), both instants of
every pair are probed in one as-of pass over the readings (one shuffle on
``(vehicle, time bucket)``), and the two probes of a refuel are regrouped by a
hash aggregate over primitive neighbour fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period
from fleetlog.functions.text import exact_sum, ts_text
from fleetlog.operators.asof import flatten_estimate, regroup_sides
from fleetlog.operators.sequence import BUCKET, DEFAULT_BUCKET, asof_neighbours, previous_row, running_total
from fleetlog.schema import ESTIMATED, EXACT, INSUFFICIENT, KEY, ROW, TS


def consumption_estimates(fuel: DataFrame, readings: DataFrame, keys: list[str] | None = None,
                          method: str = "linear", bucket=DEFAULT_BUCKET) -> DataFrame:
    """One row per accepted consecutive pair, estimates as EST structs.

    Columns: keys, previous_fuel_datetime, previous_row_num, fuel_datetime, row_num,
    liters, amount_eur, estimated_km, odometer_at_previous, odometer_at_current,
    liters_per_100km, cost_per_100km, cost_per_km.

    Plan: (1) each refuel learns its predecessor from the fuel log alone (bucketed
    lag); (2) both instants of every pair are probed in ONE as-of pass over the
    readings; (3) the two estimates are brought back together per refuel.  No step
    re-runs another step's shuffle.  A refuel is identified by its place in its
    (keys, bucket), so refuels that agree in time and row number stay apart.
    """
    keys = [KEY] if keys is None else list(keys)
    aligned = asof_neighbours(refuel_probes(fuel, keys, bucket), readings, keys, "odometer_km", bucket=bucket,
                              probe_buckets=fuel.select(*keys, TS))
    return estimates_of(aligned, keys, method)


def refuel_probes(fuel: DataFrame, keys: list[str], bucket=DEFAULT_BUCKET) -> DataFrame:
    """Two probes of each refuel: its own instant (``_side`` 1) and its predecessor's (0)."""
    f = fuel.select(*keys, TS, ROW, "liters", "amount_eur")
    f = previous_row(f, keys, {"ts": F.col(TS), "n": F.col(ROW)}, "_prev", bucket=bucket,
                     ties=["liters", "amount_eur"], position="_pos").withColumnRenamed(BUCKET, "_own")
    sides = F.array_compact(F.array(
        F.struct(F.lit(1).alias("side"), F.col(TS).alias("t")),
        F.when(F.col("_prev").isNotNull(), F.struct(F.lit(0).alias("side"), F.col("_prev.ts").alias("t")))))
    return (f.select(*keys, "_own", "_pos", F.col(TS).alias("_cur_ts"), F.col(ROW).alias("_cur_row"), "liters", "amount_eur",
                     F.col("_prev.ts").alias("_prev_ts"), F.col("_prev.n").alias("_prev_n"),
                     F.explode(sides).alias("_s"))
            .select("*", F.col("_s.side").alias("_side"), F.col("_s.t").alias(TS)).drop("_s"))


def estimates_of(aligned: DataFrame, keys: list[str], method: str = "linear") -> DataFrame:
    """Accepted pairs from the answered probes of ``refuel_probes``."""
    # the two probes of each refuel back on one row (hash aggregate, see regroup_sides)
    pairs = regroup_sides(aligned, [*keys, "_own", "_pos", "_cur_ts"], "_side",
                          {0: ("odometer_at_previous", "_prev_ts"), 1: ("odometer_at_current", "_cur_ts")},
                          method, extra=["_cur_row", "_prev_ts", "_prev_n", "liters", "amount_eur"])
    prev = F.struct(F.col("_prev_ts").alias("ts"), F.col("_prev_n").alias("n"))
    cur, prv = F.col("odometer_at_current"), F.col("odometer_at_previous")
    km = cur["value"] - prv["value"]
    keep = (F.col("_prev_ts").isNotNull() & (prv["quality"] != INSUFFICIENT) & (cur["quality"] != INSUFFICIENT)
            & (km > 0))
    quality = F.when((prv["quality"] == ESTIMATED) | (cur["quality"] == ESTIMATED),
                     F.lit(ESTIMATED)).otherwise(F.lit(EXACT))
    interval = F.concat(ts_text("_prev_ts"), F.lit(" -> "), ts_text("_cur_ts"))

    def est_col(v):
        return F.struct(v.alias("value"), quality.alias("quality"), F.lit(method).alias("method"),
                        interval.alias("source_interval"))

    return pairs.filter(keep).select(
        *keys,
        prev["ts"].alias("previous_fuel_datetime"), prev["n"].alias("previous_row_num"),
        F.col("_cur_ts").alias("fuel_datetime"), F.col("_cur_row").alias(ROW), "liters", "amount_eur",
        km.alias("estimated_km"), "odometer_at_previous", "odometer_at_current",
        est_col(F.col("liters") / km * 100).alias("liters_per_100km"),
        est_col(F.col("amount_eur") / km * 100).alias("cost_per_100km"),
        est_col(F.col("amount_eur") / km).alias("cost_per_km"),
    )


def consumption_flat(estimates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The 22-column flat form of consumption estimates (P9), plus keys and row numbers."""
    keys = [KEY] if keys is None else list(keys)
    e = F.col
    return estimates.select(
        *keys, "previous_row_num", ROW,
        e("previous_fuel_datetime"), e("fuel_datetime").alias("datetime"), "liters", "estimated_km",
        *flatten_estimate("odometer_at_previous"), *flatten_estimate("odometer_at_current"),
        e("liters_per_100km.value").alias("liters_per_100km"),
        e("liters_per_100km.quality").alias("liters_per_100km_quality"),
        e("liters_per_100km.method").alias("liters_per_100km_method"),
        e("cost_per_100km.value").alias("cost_per_100km"),
        e("cost_per_100km.quality").alias("cost_per_100km_quality"),
        e("cost_per_km.value").alias("cost_per_km"),
        e("cost_per_km.quality").alias("cost_per_km_quality"),
        e("liters_per_100km.method").alias("estimation_method"),
        e("liters_per_100km.source_interval").alias("source_interval"),
        "amount_eur",
    )


def _mean(c: str) -> Column:
    return F.try_divide(exact_sum(c, 15), F.count(c))


def consumption_summary(estimates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unweighted means over segments per key (C4); keys without segments are absent."""
    keys = [KEY] if keys is None else list(keys)
    return estimates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"),
        _mean("liters_per_100km.value").alias("avg_l_per_100km"),
        _mean("cost_per_100km.value").alias("avg_cost_per_100km"),
        _mean("cost_per_km.value").alias("avg_cost_per_km"),
        F.max(F.col("liters_per_100km.quality") == ESTIMATED).alias("any_estimated"),
    )


def consumption_in_period(fuel: DataFrame, readings: DataFrame, period: Period,
                          keys: list[str] | None = None, method: str = "linear",
                          bucket=DEFAULT_BUCKET) -> DataFrame:
    """Fuel restricted to the period first, odometer support from the full log."""
    return consumption_estimates(fuel.filter(period.contains(TS)), readings, keys, method, bucket)


def consumption_chunks(estimates: DataFrame, keys: list[str] | None = None, size: int = 1000,
                       bucket=DEFAULT_BUCKET) -> DataFrame:
    """The series as rows ``(keys, chunk, first_datetime, last_datetime, points)`` of at most
    ``size`` points each, in order: a history of any length is served without one unbounded
    row.  Points are numbered by a bucketed running count, so a key's points never meet
    in one task (C6, S10)."""
    keys = [KEY] if keys is None else list(keys)
    points = consumption_series(estimates, keys)
    numbered = running_total(points, keys, F.lit(1).cast("long"), "_place", ts="datetime", bucket=bucket)
    point = F.struct("_place", "datetime", ROW, "liters_per_100km", "quality")
    chunks = numbered.groupBy(*keys, F.floor((F.col("_place") - 1) / F.lit(size)).alias("chunk")).agg(
        F.sort_array(F.collect_list(point)).alias("points"))
    return chunks.select(*keys, "chunk", F.col("points")[0]["datetime"].alias("first_datetime"),
                         F.element_at("points", -1)["datetime"].alias("last_datetime"),
                         F.transform("points", lambda p: p.dropFields("_place")).alias("points"))


def consumption_series(estimates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(datetime, liters_per_100km, quality)`` for charts."""
    keys = [KEY] if keys is None else list(keys)
    return estimates.select(*keys, F.col("fuel_datetime").alias("datetime"), ROW,
                            F.col("liters_per_100km.value").alias("liters_per_100km"),
                            F.col("liters_per_100km.quality").alias("quality"))
