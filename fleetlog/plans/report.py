"""Report sections, summaries and the analysis payload as DataFrames.

``build_report`` returns a dict of DataFrames for one period; what the sections
share is computed once by ``base.period_base``.
KPI cards are long rows ``(keys, section, position, metric, value, unit,
source, tone, note)`` with numeric values; formatting is left to the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period
from fleetlog.functions.text import iso_text
from fleetlog.operators import aggregates as agg
from fleetlog.operators.asof import odometer_at
from fleetlog.operators.consumption import consumption_chunks, consumption_flat, consumption_series
from fleetlog.operators.distance import odometer_readings_in_period
from fleetlog.operators.sequence import key_id
from fleetlog.plans.base import PeriodBase, period_base
from fleetlog.schema import ESTIMATED, EXACT, INSUFFICIENT, KEY, ROW, TS

FUEL_SRC = "Fuel log"
ODO_SRC = "Odometer log"
EST_SRC = "Odometer log + linear interpolation"
CONS_SRC = "Fuel log + odometer log via linear interpolation"
CONS_EMPTY_SRC = "Fuel log + odometer log"


def _keys(keys):
    return [KEY] if keys is None else list(keys)


def _card(position: int, metric: str, value: str, unit: str, source: str, tone: str, note: str = "''",
          when: str | None = None) -> str:
    """SQL text of one KPI card struct; ``value``, ``tone``, ``note`` and ``when`` are SQL expressions."""
    card = (f"named_struct('position', {position}, 'metric', '{metric}', 'value', CAST({value} AS DOUBLE), "
            f"'unit', '{unit}', 'source', '{source}', 'tone', {tone}, 'note', {note})")
    return f"CASE WHEN {when} THEN {card} END" if when else card


def _cards(df: DataFrame, keys: list[str], sections: dict[str, list[str]]) -> DataFrame:
    listed = [f"array_compact(array({', '.join(cards)}))" for cards in sections.values()]
    tagged = ", ".join(f"transform({c}, c -> named_struct('section', '{n}', 'card', c))" for n, c in zip(sections, listed))
    return df.select(*keys, F.expr(f"explode(concat({tagged}))").alias("_c")).select(*keys, "_c.section", "_c.card.*")


def key_universe(fuel: DataFrame, odo: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every key present in either log."""
    k = _keys(keys)
    return fuel.select(*k).unionByName(odo.select(*k)).distinct()


def _fuel_cards() -> list[str]:
    """Stops, litres, EUR and weighted price; a key without stops gets only ``stops = 0`` (K1)."""
    has = "entries > 0"
    ex = f"'{EXACT}'"
    return [
        _card(1, "fuel_stops", "entries", "count", FUEL_SRC, f"CASE WHEN {has} THEN {ex} ELSE 'neutral' END"),
        _card(2, "fuel_purchased", "coalesce(total_liters, 0.0)", "L", FUEL_SRC, ex, when=has),
        _card(3, "fuel_spending", "coalesce(total_eur, 0.0)", "EUR", FUEL_SRC, ex, when=has),
        _card(4, "average_fuel_price", "avg_price_per_liter", "EUR/L", FUEL_SRC, ex, when=has),
    ]


def _distance_cards() -> list[str]:
    """Readings and observed distance in the period (in-period readings only) and the
    estimated overall distance between the period bounds over the full log (K2)."""
    insufficient = f"distance.quality = '{INSUFFICIENT}'"
    note = (f"CASE WHEN {insufficient} THEN coalesce(distance.source_interval, "
            f"'Not enough odometer data is available for the selected period.') "
            f"WHEN distance.quality = '{EXACT}' THEN '' ELSE 'At least one report boundary required interpolation.' END")
    return [
        _card(1, "observed_odometer_readings", "readings", "count", ODO_SRC, f"'{EXACT}'"),
        _card(2, "observed_distance_driven", "total_km", "km", ODO_SRC, f"'{EXACT}'"),
        _card(3, "estimated_overall_distance_driven", f"CASE WHEN {insufficient} THEN NULL ELSE distance.value END",
              "km", EST_SRC, f"CASE WHEN distance.quality = '{EXACT}' THEN '{EXACT}' ELSE '{ESTIMATED}' END", note),
    ]


def _estimated_cards() -> list[str]:
    """Consumption intervals and unweighted means; none -> ``intervals = 0`` (K3)."""
    has = "coalesce(segments, 0) > 0"
    tone = f"CASE WHEN NOT ({has}) THEN 'neutral' WHEN any_estimated THEN '{ESTIMATED}' ELSE '{EXACT}' END"
    return [
        _card(1, "consumption_intervals", "segments", "count", CONS_SRC, tone, when=has),
        _card(1, "consumption_intervals", "0", "count", CONS_EMPTY_SRC, tone, when=f"NOT ({has})"),
        _card(2, "average_consumption", "avg_l_per_100km", "L/100km", CONS_SRC, tone, when=has),
        _card(3, "average_cost_per_100km", "avg_cost_per_100km", "EUR", CONS_SRC, tone, when=has),
        _card(4, "average_cost_per_km", "avg_cost_per_km", "EUR", CONS_SRC, tone, when=has),
    ]


def fuel_cards(base: PeriodBase) -> DataFrame:
    return _cards(base.totals, base.keys, {"fuel": _fuel_cards()})


def distance_cards(base: PeriodBase) -> DataFrame:
    return _cards(base.totals.join(base.bounds, "_kid"), base.keys, {"distance": _distance_cards()})


def estimated_cards(base: PeriodBase) -> DataFrame:
    return _cards(base.totals.join(base.summary, "_kid", "left"), base.keys, {"estimated": _estimated_cards()})


def _boundary_quality(est: str) -> tuple[Column, Column, Column]:
    q = F.col(f"{est}.quality")
    default = (F.when(q == INSUFFICIENT, F.lit("Not enough odometer data."))
               .when(q == EXACT, F.lit("Exact reading.")).otherwise(F.lit("Estimated by interpolation.")))
    return (F.when(q == INSUFFICIENT, F.lit(None)).otherwise(F.col(f"{est}.value")).alias("odometer_km"), q.alias("quality"),
            F.coalesce(F.col(f"{est}.source_interval"), default).alias("supporting_data"))


def boundaries(base: PeriodBase) -> DataFrame:
    """Odometer estimate at the period start and end with its basis (K4)."""
    t = base.totals.join(base.bounds, "_kid")
    parts = [t.select(*base.keys, F.lit(label).alias("boundary"), F.lit(at).cast("timestamp_ntz").alias(TS), *_boundary_quality(c))
             for label, at, c in (("Start of report", base.period.start, "start_odometer"), ("End of report", base.period.end, "end_odometer"))]
    return parts[0].unionByName(parts[1])


def boundary_estimates(odo: DataFrame, period: Period, universe: DataFrame,
                       keys: list[str] | None = None) -> DataFrame:
    """Odometer estimate at the period start and end with its basis (K4)."""
    k = _keys(keys)
    probes = universe.select(*k, F.explode(F.array(
        F.struct(F.lit("Start of report").alias("boundary"), F.lit(period.start).cast("timestamp_ntz").alias("t")),
        F.struct(F.lit("End of report").alias("boundary"), F.lit(period.end).cast("timestamp_ntz").alias("t")))
    ).alias("_b")).select(*k, "_b.boundary", F.col("_b.t").alias(TS), F.lit(None).cast("long").alias(ROW))
    return odometer_at(probes, odo, k, "est").select(*k, "boundary", TS, *_boundary_quality("est"))


def report_cards(fuel: DataFrame, odo: DataFrame, period: Period, keys: list[str] | None = None) -> DataFrame:
    """K1 + K2 + K3 cards for one period in long form, from one stored base."""
    base = period_base(fuel, odo, period, keys)
    t = base.totals.join(base.bounds, "_kid").join(base.summary, "_kid", "left")
    return _cards(t, base.keys, {"fuel": _fuel_cards(), "distance": _distance_cards(), "estimated": _estimated_cards()})


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0.0)).alias(c)


def summary_all(fuel: DataFrame, odo: DataFrame, keys: list[str] | None = None,
                fuel_errors: DataFrame | None = None) -> DataFrame:
    """Whole-log summary per key: A1-A4, readings and total distance, C4 (K8).

    ``incomplete`` flags keys with validation errors when an errors frame is given."""
    base = period_base(fuel, odo, None, keys)
    k = base.keys
    out = base.totals.join(base.summary, "_kid", "left")
    columns = [*k, "entries", _zero("total_liters"), _zero("total_eur"), "avg_price_per_liter", "readings", "total_km",
               F.coalesce("segments", F.lit(0)).alias("segments"), "avg_l_per_100km", "avg_cost_per_100km"]
    if fuel_errors is not None:
        bad = fuel_errors.select(key_id(k).alias("_kid")).distinct().withColumn("incomplete", F.lit(True))
        out = out.join(bad, "_kid", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
        columns.append("incomplete")
    return out.select(*columns)


def _metrics(base: PeriodBase) -> DataFrame:
    return base.totals.join(base.summary, "_kid", "left").select(
        "_kid", *base.keys, _zero("total_liters"), _zero("total_eur"), "avg_price_per_liter", "entries",
        "avg_l_per_100km", "avg_cost_per_100km", F.coalesce("segments", F.lit(0)).alias("segments"))


def analysis_metrics(fuel: DataFrame, odo: DataFrame, period: Period, keys: list[str] | None = None) -> DataFrame:
    """In-range fuel totals and consumption means, odometer support from the full log (K9).

    Keys present in either log; means are null when a key has no segments."""
    return _metrics(period_base(fuel, odo, period, keys)).drop("_kid", "segments")


def _series(base: PeriodBase) -> dict[str, DataFrame]:
    k = base.keys
    months = base.months.withColumn("month", F.date_format("month", "yyyy-MM"))
    return {
        "price_trend": months.select(*k, "month", "avg_price_per_liter"),
        "monthly_liters": months.select(*k, "month", F.col("liters").alias("value")),
        "monthly_spending": months.select(*k, "month", F.col("amount_eur").alias("value")),
        "fuel_type_summary": base.by("fuel_type").drop("avg_price_per_liter"),
        "country_breakdown": base.by("country").select(*k, "country", "avg_price_per_liter", "total_liters"),
        "consumption_series": consumption_series(base.estimates, k).withColumn("datetime", iso_text("datetime")),
    }


def analysis_series(fuel: DataFrame, odo: DataFrame, period: Period,
                    keys: list[str] | None = None) -> dict[str, DataFrame]:
    """The six chart series of the analysis view as plain DataFrames."""
    return _series(period_base(fuel, odo, period, keys))


# Series whose length is bounded by the calendar or a small domain (months,
# fuel types, countries) are nested into the payload; the consumption series
# grows with the number of refuels and is served beside it in chunks of bounded
# size (``payload_chunks``), so no single row has to hold an unbounded history.
NESTED_SERIES = ("price_trend", "monthly_liters", "monthly_spending", "fuel_type_summary", "country_breakdown")


def _payload(base: PeriodBase, range_key: str) -> DataFrame:
    k, period = base.keys, base.period
    series = _series(base)
    out = _metrics(base)
    metrics = [c for c in out.columns if c not in ("_kid", "segments", *k)]
    out = out.select("_kid", *k, F.struct(*metrics).alias("metrics"), F.col("segments").alias("consumption_points"))

    def nested(df: DataFrame, arrays: dict[str, list[str]]) -> DataFrame:
        lists = [F.array_sort(F.collect_list(F.struct(*cols))).alias(n) for n, cols in arrays.items()]
        return df.groupBy(key_id(k).alias("_kid")).agg(*lists)

    # the three monthly series come from one table of months
    months = base.months.withColumn("month", F.date_format("month", "yyyy-MM"))
    monthly = nested(months, {n: ["month", F.col(c).alias(v)] for n, c, v in (
        ("price_trend", "avg_price_per_liter", "avg_price_per_liter"), ("monthly_liters", "liters", "value"),
        ("monthly_spending", "amount_eur", "value"))})
    parts = [monthly] + [nested(series[n], {n: [first, *[c for c in series[n].columns if c not in (first, *k)]]})
                         for n, first in (("fuel_type_summary", "fuel_type"), ("country_breakdown", "country"))]
    for part in parts:
        out = out.join(part, "_kid", "left")
    out = out.withColumns({n: F.coalesce(F.col(n), F.array()) for n in NESTED_SERIES})
    charts = F.struct(*[F.col(n) for n in NESTED_SERIES])
    return out.select(*k, F.lit(range_key).alias("range"), F.lit(period.label).alias("range_label"),
                      F.lit(period.start.isoformat()).alias("start"), F.lit(period.end.isoformat()).alias("end"),
                      "metrics", charts.alias("charts"), "consumption_points").withColumn(
        "payload", F.to_json(F.struct("range", "range_label", "start", "end", "metrics", "charts")))


def analysis_payload(fuel: DataFrame, odo: DataFrame, period: Period, range_key: str = "custom",
                     keys: list[str] | None = None) -> DataFrame:
    """One row per key: range, label, bounds, metrics struct, bounded chart arrays and
    the consumption series length; ``payload`` is the JSON text (S10)."""
    return _payload(period_base(fuel, odo, period, keys), range_key)


def payload_chunks(fuel: DataFrame, odo: DataFrame, period: Period, keys: list[str] | None = None,
                   size: int = 1000) -> DataFrame:
    """The consumption series of the payload in rows of at most ``size`` points."""
    return consumption_chunks(period_base(fuel, odo, period, keys).estimates, keys, size)


def build_report(fuel: DataFrame, odo: DataFrame, period: Period, keys: list[str] | None = None,
                 fuel_issues: DataFrame | None = None, odo_issues: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report sections for one period (K7); keys default to ``[vehicle_id]``.

    Cards, boundaries, consumption and the series by month, type and country read one
    stored base; the sections that list the log's own rows are lazy plans over it:
    pass stored logs (``store.read_log``), of which they read only their columns and months."""
    base = period_base(fuel, odo, period, keys)
    k = base.keys
    fuel_p = fuel.filter(period.contains(TS))
    types = base.by("fuel_type").drop("avg_price_per_liter")
    readings = odometer_readings_in_period(odo, period, k)
    sections = {
        "fuel_cards": fuel_cards(base),
        "distance_cards": distance_cards(base),
        "estimated_cards": estimated_cards(base),
        "boundaries": boundaries(base),
        "consumption": consumption_flat(base.estimates, k),
        "overview_fuel": fuel_p.select(*k, TS, ROW, "liters"),
        # the readings' deltas are the timeline; a reading without one is not on it
        "overview_distance": readings.filter(F.col("km_since_previous").isNotNull()).select(
            *k, TS, ROW, F.col("km_since_previous").alias("km_since_last_entry")),
        "price_over_time": agg.fuel_price_over_time(fuel_p, k),
        "monthly_liters": base.months.select(*k, "month", "liters"),
        "monthly_spending": base.months.select(*k, "month", "amount_eur"),
        "fuel_type_summary": types,
        "fuel_type_share": agg.shares(types, k),
        "country_overview": agg.ranked(base.by("country").withColumnsRenamed(
            {"count": "stops", "total_liters": "liters", "total_eur": "eur"}), "country", k),
        "city_overview": agg.location_overview(fuel_p, "city", k),
        "odometer_readings": readings,
    }
    issues = [i for i in (fuel_issues, odo_issues) if i is not None]
    if issues:
        allis = issues[0]
        for extra in issues[1:]:
            allis = allis.unionByName(extra, allowMissingColumns=True)
        # a duplicate issue counts the pairs that it stands for, as in issue_summary
        weight = F.coalesce("pairs", F.lit(1)) if "pairs" in allis.columns else F.lit(1)
        sections["issue_counts"] = allis.groupBy("dataset", "severity").agg(F.sum(weight).alias("issues"))
    return sections
