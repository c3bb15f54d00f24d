"""As-of alignment of probe times with odometer readings, and interpolation.

``odometer_at`` attaches to every probe row the odometer estimate at its
timestamp as an ``EST`` struct ``(value, quality, method, source_interval)``:

* a reading at the same instant -> ``exact`` (first of tied readings),
* otherwise the last reading strictly before and the first strictly after
  -> linear interpolation, ``estimated``,
* otherwise ``insufficient`` with value 0.0 (no extrapolation).

Plan: probes and readings are unioned and aligned with
``sequence.asof_neighbours`` -- one shuffle on ``(keys, time bucket)``,
O(N log N), no join between the two logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.text import EPOCH_MICROS_SQL, ts_text_sql
from fleetlog.operators.sequence import BUCKET, DEFAULT_BUCKET, asof_neighbours
from fleetlog.schema import ESTIMATED, EXACT, INSUFFICIENT, KEY, ROW, TS

def _linear(t: str, before: str, after: str, exact: str) -> Column:
    """Linear interpolation between the bracketing readings (EST struct).

    Inputs are column names: the probe time and the three neighbour structs
    ``(_t, _n, ts, km)``.  Built as one SQL expression (parsed once on the JVM)."""
    b, a, x = before, after, exact
    both = f"({b} IS NOT NULL AND {a} IS NOT NULL)"
    t_us = EPOCH_MICROS_SQL.format(t)
    # seconds as Python's timedelta.total_seconds() gives them
    frac = f"(({t_us} - {b}._t) / 1e6) / (({a}._t - {b}._t) / 1e6)"
    return F.expr(f"""named_struct(
        'value', CAST(CASE WHEN {x} IS NOT NULL THEN {x}.km
                           WHEN {both} THEN {b}.km + {frac} * ({a}.km - {b}.km)
                           ELSE 0.0 END AS DOUBLE),
        'quality', CASE WHEN {x} IS NOT NULL THEN '{EXACT}' WHEN {both} THEN '{ESTIMATED}' ELSE '{INSUFFICIENT}' END,
        'method', 'linear',
        'source_interval', CASE WHEN {x} IS NOT NULL THEN concat('exact match at ', {ts_text_sql(x + '.ts')})
                                WHEN {both} THEN concat({ts_text_sql(b + '.ts')}, ' -> ', {ts_text_sql(a + '.ts')})
                                WHEN {a} IS NOT NULL THEN concat('before first record (', {ts_text_sql(a + '.ts')}, ')')
                                WHEN {b} IS NOT NULL THEN concat('after last record (', {ts_text_sql(b + '.ts')}, ')')
                           END)""")
    # both neighbours missing <=> the key has no readings at all: the interval stays null


# Interpolation strategies by name; each maps (t, before, after, exact) to an EST column.
STRATEGIES = {"linear": _linear}


def get_interpolation_strategy(method: str = "linear"):
    if method not in STRATEGIES:
        raise ValueError(f"Unknown interpolation method: '{method}'. Available: {sorted(STRATEGIES)}")
    return STRATEGIES[method]


def attach_odometer(probes: DataFrame, readings: DataFrame, keys: list[str] | None = None,
                    out: str = "odometer", method: str = "linear", ts: str = TS,
                    row: str = ROW, km: str = "odometer_km", bucket=DEFAULT_BUCKET,
                    probe_buckets: DataFrame | None = None) -> DataFrame:
    """Probes + ``out`` EST column (see ``sequence.asof_neighbours`` for the plan)."""
    keys = [KEY] if keys is None else list(keys)
    strategy = get_interpolation_strategy(method)
    aligned = asof_neighbours(probes, readings, keys, km, ts, row, bucket, probe_buckets)
    est = strategy(ts, "_before", "_after", "_exact")
    return aligned.withColumn(out, est).drop("_before", "_after", "_exact")


def odometer_at(probes: DataFrame, readings: DataFrame, keys: list[str] | None = None,
                out: str = "odometer", method: str = "linear", ts: str = TS, row: str = ROW,
                km: str = "odometer_km", bucket=DEFAULT_BUCKET) -> DataFrame:
    """Odometer estimate at each probe's timestamp."""
    return attach_odometer(probes, readings, keys, out, method, ts, row, km, bucket).drop(BUCKET)


def flatten_estimate(c: str, prefix: str | None = None) -> list[Column]:
    """EST struct -> ``prefix``, ``prefix_quality``, ``prefix_method``, ``prefix_source_interval``."""
    p = prefix or c
    return [F.col(c)["value"].alias(p), F.col(c)["quality"].alias(f"{p}_quality"),
            F.col(c)["method"].alias(f"{p}_method"), F.col(c)["source_interval"].alias(f"{p}_source_interval")]


def _combine_distance(start: str, end: str, start_ts: str, end_ts: str) -> Column:
    """EST distance between two boundary estimates (I8); inputs are column names."""
    insufficient = f"({start}.quality = '{INSUFFICIENT}' OR {end}.quality = '{INSUFFICIENT}')"
    dist = f"({end}.value - {start}.value)"
    return F.expr(f"""named_struct(
        'value', CASE WHEN {insufficient} OR {dist} < 0 THEN 0.0D ELSE {dist} END,
        'quality', CASE WHEN {insufficient} OR {dist} < 0 THEN '{INSUFFICIENT}'
                        WHEN {start}.quality = '{ESTIMATED}' OR {end}.quality = '{ESTIMATED}' THEN '{ESTIMATED}'
                        ELSE '{EXACT}' END,
        'method', {start}.method,
        'source_interval', CASE
            WHEN {insufficient} THEN concat('start: ', coalesce({start}.source_interval, 'unknown'),
                                            '; end: ', coalesce({end}.source_interval, 'unknown'))
            WHEN {dist} < 0 THEN concat('negative distance between ', {ts_text_sql(start_ts)}, ' and ',
                                        {ts_text_sql(end_ts)})
            ELSE concat('start: ', coalesce({start}.source_interval, {ts_text_sql(start_ts)}),
                        '; end: ', coalesce({end}.source_interval, {ts_text_sql(end_ts)})) END)""")


_NB_PARTS = {"t": "_t", "ts": "ts", "km": "km"}


def regroup_sides(aligned: DataFrame, group: list[str], side: str, sides: dict[int, tuple[str, str]],
                  method: str = "linear", extra: list[str] = ()) -> DataFrame:
    """Bring several as-of probes of one entity onto one row.

    ``aligned`` is ``asof_neighbours`` output with a ``side`` column; ``sides`` maps a
    side value to ``(output EST column, probe time column)``.  The regroup is a hash
    aggregate over primitive neighbour fields (time, km); the EST structs and their
    provenance text are built after it.  ``extra`` primitive columns are carried
    (``max``; they must be equal on all sides)."""
    strategy = get_interpolation_strategy(method)
    aggs = [F.max(F.when(F.col(side) == v, F.col(f"_{nb}.{fld}"))).alias(f"_{nb}_{p}{v}")
            for v in sides for nb in ("before", "after", "exact") for p, fld in _NB_PARTS.items()]
    aggs += [F.max(F.when(F.col(side) == v, F.col(t))).alias(f"_t{v}") for v, (_, t) in sides.items()]
    aggs += [F.max(c).alias(c) for c in extra]
    out = aligned.groupBy(*group).agg(*aggs)
    out = out.withColumns({f"_{nb}{v}": F.when(F.col(f"_{nb}_t{v}").isNotNull(), F.struct(
        *[F.col(f"_{nb}_{p}{v}").alias(fld) for p, fld in _NB_PARTS.items()]))
        for v in sides for nb in ("before", "after", "exact")})
    out = out.withColumns({name: strategy(f"_t{v}", f"_before{v}", f"_after{v}", f"_exact{v}")
                           for v, (name, _) in sides.items()})
    return out.drop(*[c for c in out.columns if c.startswith(("_before", "_after", "_exact", "_t"))
                      and c not in group])


def distance_between(bounds: DataFrame, readings: DataFrame, keys: list[str] | None = None,
                     start: str = "start", end: str = "end", out: str = "distance",
                     method: str = "linear", bucket=DEFAULT_BUCKET) -> DataFrame:
    """Per distinct ``(keys, start, end)`` of ``bounds``: odometer distance as EST (I8).

    Returns keys, start, end, ``start_odometer``, ``end_odometer`` and ``out``.
    A row with ``start > end`` fails the query, like the original's ValueError.
    """
    keys = [KEY] if keys is None else list(keys)
    s = F.when(F.col(start) > F.col(end),
               F.raise_error(F.lit("start_dt must be before or equal to end_dt"))).otherwise(F.col(start))
    probes = bounds.select(*keys, s.alias("_s"), F.col(end).alias("_e")).select(
        *keys, "_s", "_e", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_s").alias("t")),
                                             F.struct(F.lit(1).alias("side"), F.col("_e").alias("t")))).alias("_p")
    ).select(*keys, "_s", "_e", F.col("_p.side").alias("_side"), F.col("_p.t").alias(TS))
    aligned = asof_neighbours(probes, readings, keys, "odometer_km", bucket=bucket)
    est = regroup_sides(aligned, [*keys, "_s", "_e"], "_side",
                        {0: ("start_odometer", "_s"), 1: ("end_odometer", "_e")}, method)
    return distance_of(est, "start_odometer", "end_odometer", "_s", "_e", out).withColumnRenamed("_s", start).withColumnRenamed("_e", end)


def distance_of(df: DataFrame, start: str, end: str, start_ts: str, end_ts: str, out: str = "distance") -> DataFrame:
    """``df`` with the EST distance between two EST columns at two instants."""
    return df.withColumn(out, _combine_distance(start, end, start_ts, end_ts))
