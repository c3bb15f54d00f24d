"""The registered queries: library operators applied to the fixture views.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and rounding match its DuckDB twin in ``oracle_sql``.  Doubles that
come from sums or divisions are rounded to 6 decimals on both sides so that
summation order cannot change the comparison.  Every query reads whole
driver tables through the fixture views.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.functions.calendar import RANGE_KEYS, Period, normalize_boundary, resolve_range
from fleetlog.functions.text import exact_sum, fixed, round6
from fleetlog.operators import aggregates as agg
from fleetlog.operators import distance as dist
from fleetlog.operators import lookups as lk
from fleetlog.operators import rules
from fleetlog.operators.asof import distance_between, odometer_at
from fleetlog.operators.consumption import (
    consumption_estimates, consumption_flat as _flat, consumption_in_period as _in_period,
    consumption_series as _series, consumption_summary as _summary,
)
from fleetlog.plans import report
from fleetlog.schema import FUEL_RAW_COLUMNS, FUEL_SCHEMA, KEY, ODO_RAW_COLUMNS, ODO_SCHEMA, ROW, TS
from fleetlog.session import scratch_path
from fleetlog.sources import csv as csvsrc, fixtures as fx, store

Query = Callable[[SparkSession, str], DataFrame]

# Fixed query parameters (the oracle uses the same literals).
PERIOD = Period(normalize_boundary(date(2024, 1, 8), None, False),
                normalize_boundary(date(2024, 1, 21), None, True))
AS_OF = datetime(2024, 1, 20, 12, 0, 0)
CUSTOM = ("2024-01-08", "2024-01-21")
HISTORY_K = 3
IMPORT_CUTOFF = datetime(2024, 1, 4)   # the store already holds the first three days
VEHICLES = (1, 7, 11)                  # read one by one from a store
PRIMARY_NATIONS = ("GERMANY", "FRANCE", "ITALY")


def _r6(*cols):
    return [round6(c).alias(c.split(".")[-1] if isinstance(c, str) else c) for c in cols]


# --- fuel aggregates --------------------------------------------------------

def fuel_totals(spark, d):
    t = agg.fuel_totals(fx.fx_log(spark, d))
    return t.select(KEY, "entries", *_r6("total_liters", "total_eur", "avg_price_per_liter"))


def month_to_date(spark, d):
    t = agg.month_to_date(fx.fx_fuel(spark, d), AS_OF)
    return t.select(KEY, "month_entries", *_r6("month_liters", "month_eur"))


def fuel_price_over_time(spark, d):
    # a single division: identical IEEE result in every engine, so it is not rounded
    return agg.fuel_price_over_time(fx.fx_fuel(spark, d)).select(KEY, TS, ROW, "price_per_liter_eur")


def fuel_type_summary(spark, d):
    return agg.fuel_type_summary(fx.fx_log(spark, d)).select(KEY, "fuel_type", "count",
                                                              *_r6("total_liters", "total_eur"))


def fuel_type_share(spark, d):
    return agg.fuel_type_share(fx.fx_log(spark, d)).select(
        KEY, "fuel_type", "count", *_r6("stops_share_pct", "liters_share_pct", "eur_share_pct"))


def avg_price_by_country(spark, d):
    return agg.avg_price_by_country(fx.fx_log(spark, d)).select(KEY, "country",
                                                                 *_r6("avg_price_per_liter", "total_liters"))


def avg_price_by_city(spark, d):
    return agg.avg_price_by_city(fx.fx_log(spark, d)).select(KEY, "city", *_r6("avg_price_per_liter", "total_liters"))


def _overview(column):
    def q(spark, d):
        return agg.location_overview(fx.fx_log(spark, d), column).select(
            KEY, column, "stops", *_r6("liters", "eur", "avg_price_per_liter"), "rank")
    q.__name__ = f"location_overview_{column}"
    return q


def monthly_liters(spark, d):
    return agg.monthly_liters(fx.fx_gap_log(spark, d)).select(KEY, "month", *_r6("liters"))


def monthly_spending(spark, d):
    return agg.monthly_spending(fx.fx_gap_log(spark, d)).select(KEY, "month", *_r6("amount_eur"))


def fuel_price_trend(spark, d):
    return agg.fuel_price_trend(fx.fx_gap_log(spark, d)).select(KEY, "month", *_r6("avg_price_per_liter"))


# --- odometer series --------------------------------------------------------

def total_distance(spark, d):
    return dist.total_distance(fx.fx_odo(spark, d)).select(KEY, "readings", *_r6("total_km"))


def total_distance_raw(spark, d):
    return dist.total_distance(fx.fx_odo_raw(spark, d)).select(KEY, "readings", *_r6("total_km"))


def monthly_km_driven(spark, d):
    return dist.monthly_km_driven(fx.fx_odo(spark, d)).select(KEY, "month", *_r6("km_driven"))


def cumulative_distance(spark, d):
    return dist.cumulative_distance(fx.fx_odo(spark, d)).select(KEY, TS, ROW, *_r6("cumulative_km"))


def distance_timeline(spark, d):
    return dist.distance_timeline(fx.fx_odo(spark, d), PERIOD).select(KEY, TS, ROW, *_r6("km_since_last_entry"))


def odometer_readings_in_period(spark, d):
    return dist.odometer_readings_in_period(fx.fx_odo(spark, d), PERIOD).select(
        KEY, TS, ROW, *_r6("odometer_km", "km_since_previous"))


# --- as-of, consumption -----------------------------------------------------

def odometer_at_fuel(spark, d):
    e = odometer_at(fx.fx_fuel(spark, d).select(KEY, TS, ROW), fx.fx_odo(spark, d))
    return e.select(KEY, TS, ROW, round6("odometer.value").alias("odometer_km"),
                    F.col("odometer.quality").alias("quality"), F.col("odometer.method").alias("method"),
                    F.col("odometer.source_interval").alias("source_interval"))


def _segments(c: DataFrame) -> DataFrame:
    return c.select(KEY, "previous_fuel_datetime", "previous_row_num", "fuel_datetime", ROW,
                    "liters", "amount_eur", round6("estimated_km").alias("estimated_km"),
                    round6("odometer_at_previous.value").alias("odometer_at_previous"),
                    round6("odometer_at_current.value").alias("odometer_at_current"),
                    round6("liters_per_100km.value").alias("liters_per_100km"),
                    round6("cost_per_100km.value").alias("cost_per_100km"),
                    round6("cost_per_km.value").alias("cost_per_km"),
                    F.col("liters_per_100km.quality").alias("quality"),
                    F.col("liters_per_100km.source_interval").alias("source_interval"))


def consumption_segments(spark, d):
    return _segments(consumption_estimates(fx.fx_fuel(spark, d), fx.fx_odo(spark, d)))


def consumption_in_period(spark, d):
    return _segments(_in_period(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), PERIOD))


def consumption_flat(spark, d):
    f = _flat(consumption_estimates(fx.fx_fuel(spark, d), fx.fx_odo(spark, d)))
    num = ["estimated_km", "odometer_at_previous", "odometer_at_current", "liters_per_100km", "cost_per_100km",
           "cost_per_km"]
    return f.select(*[round6(c).alias(c) if c in num else F.col(c) for c in f.columns])


def consumption_summary(spark, d):
    s = _summary(consumption_estimates(fx.fx_fuel(spark, d), fx.fx_odo(spark, d)))
    return s.select(KEY, "segments", *_r6("avg_l_per_100km", "avg_cost_per_100km", "avg_cost_per_km"), "any_estimated")


def _distance_between(readings: DataFrame) -> DataFrame:
    keys = readings.select(KEY).distinct()
    b = keys.select(KEY, F.lit(PERIOD.start).cast("timestamp_ntz").alias("start"),
                    F.lit(PERIOD.end).cast("timestamp_ntz").alias("end"))
    r = distance_between(b, readings)
    return r.select(KEY, "start", "end", round6("distance.value").alias("distance_km"),
                    F.col("distance.quality").alias("quality"),
                    F.col("distance.source_interval").alias("source_interval"))


def distance_between_q(spark, d):
    return _distance_between(fx.fx_odo(spark, d))


def distance_between_raw(spark, d):
    return _distance_between(fx.fx_odo_raw(spark, d))


def boundary_estimates(spark, d):
    fuel, odo = fx.fx_fuel(spark, d), fx.fx_odo(spark, d)
    b = report.boundary_estimates(odo, PERIOD, report.key_universe(fuel, odo))
    return b.select(KEY, "boundary", TS, round6("odometer_km").alias("odometer_km"), "quality", "supporting_data")


# --- validation ------------------------------------------------------------

def _fuel_validated(spark, d):
    return rules.validate_fuel(fx.fx_dirty(spark, d), [KEY])


def fuel_clean(spark, d):
    g = _fuel_validated(spark, d).good
    return g.select(KEY, ROW, TS, "amount_eur", "liters", "price_per_liter_eur",
                    "fuel_type", "is_full_tank", "station_name", "city", "country", "notes")


def fuel_issues(spark, d):
    i = _fuel_validated(spark, d).issues
    return i.select(KEY, "dataset", "severity", "rule", ROW, "field", "message", "pair_row_a", "pair_row_b", "pairs")


def issue_summary(spark, d):
    return rules.issue_summary(_fuel_validated(spark, d).issues)


_GROUP = ("rows", "first_row", "last_row", "earlier_rows", "nearest_ts", "nearest_row", "pairs")


def fuel_duplicates(spark, d):
    good = _fuel_validated(spark, d).good
    return rules.fuel_duplicates(good, [KEY]).select(KEY, "liters", TS, *_GROUP)


def _odo_validated(spark, d):
    return rules.validate_odometer(fx.fx_dirty_odometer(spark, d), [KEY])


def odometer_clean(spark, d):
    return _odo_validated(spark, d).good.select(KEY, ROW, TS, "odometer_km", "notes")


def odometer_issues(spark, d):
    return _odo_validated(spark, d).issues.select(KEY, "dataset", "severity", "rule", ROW, "field", "message",
                                                  "pair_row_a", "pair_row_b", "pairs")


def quality_summary(spark, d):
    # each log is read and parsed once, for its issues, its rows and its duplicates
    return rules.quality_summary(rules.validate_fuel(fx.fx_dirty(spark, d), [KEY], store=True),
                                 rules.validate_odometer(fx.fx_dirty_odometer(spark, d), [KEY], store=True))


def odometer_monotonicity(spark, d):
    m = rules.odometer_monotonicity(fx.fx_odo_raw(spark, d), [KEY])
    return m.select(KEY, TS, ROW, "odometer_km", "previous_ts", "previous_row_num", "previous_km")


def odometer_duplicates(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias(TS),
                                             F.col("event_id").alias(ROW), "event_type")
    return rules.odometer_duplicates(ev, [KEY], ["event_type"]).select(KEY, "event_type", TS, *_GROUP)


def entry_validation(spark, d):
    raw = fx.fx_dirty(spark, d).withColumnRenamed("datetime", "entry_date")
    accepted, rejected = rules.validate_entries(raw, [KEY], clean=True)
    a = accepted.select(KEY, ROW, F.lit(True).alias("accepted"), F.lit("").alias("errors"),
                        F.size("warnings").alias("warnings"), "liters", "amount_eur")
    errors = F.transform(F.array_sort(F.map_entries("errors")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    none = F.lit(None).cast("double")
    r = rejected.select(KEY, ROW, F.lit(False).alias("accepted"), F.array_join(errors, " ").alias("errors"),
                        F.lit(0).alias("warnings"), none.alias("liters"), none.alias("amount_eur"))
    return a.unionByName(r)


# --- lookups, history, periods ----------------------------------------------

def _nation_dim(spark, d):
    return fx.table(spark, d, "nation").select(F.col("n_name").alias("code"), F.lower("n_name").alias("name"))


def _stops(spark, d):
    """Stops per vehicle and country; every fourth vehicle writes codes that no dimension has."""
    log = fx.fx_log(spark, d).withColumn("country", F.when(F.col(KEY) % 4 == 0, F.concat("country", F.lit("?"))).otherwise(F.col("country")))
    return log.groupBy(KEY, "country").agg(F.count(F.lit(1)).alias("stops"))


def recent_history(spark, d):
    top = lk.fetch_entries(fx.fx_fuel(spark, d), limit=HISTORY_K)
    return lk.entry_view(top).select(KEY, ROW, "datetime", "date", "time", "liters", "amount_eur", "recency")


def country_lookup(spark, d):
    return lk.with_country_name(_stops(spark, d), _nation_dim(spark, d)).select(KEY, "country", "country_name", "stops")


def unknown_countries(spark, d):
    return lk.known_codes(_stops(spark, d), _nation_dim(spark, d), known=False).select(KEY, "country", "stops")


def country_options(spark, d):
    return lk.ordered_options(_nation_dim(spark, d), PRIMARY_NATIONS).select("code", "name", "position")


def vehicles_for_user(spark, d):
    users = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    bridge = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("car_id")).distinct()
    cars = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("car_id"), "s_name")
    return lk.vehicles_for_user(users, bridge, cars).select("user_id", "car_id", "c_name", "s_name")


def import_missing_vehicles(spark, d):
    incoming = fx.fx_fuel(spark, d)
    target = incoming.filter(F.col(TS) < F.lit(IMPORT_CUTOFF).cast("timestamp_ntz"))
    return lk.import_missing(incoming, target).groupBy(KEY).agg(F.count(F.lit(1)).alias("imported_rows"))


def report_period(spark, d):
    return lk.resolve_report_periods(fx.fx_fuel(spark, d), fx.fx_odo(spark, d)).select(KEY, "start", "end")


def range_bounds(spark, d):
    ranges = {k: resolve_range(k, AS_OF, *CUSTOM) for k in RANGE_KEYS}
    inside = {k: p.contains(TS) for k, p in ranges.items()}
    g = fx.fx_fuel(spark, d).groupBy(KEY).agg(
        *[F.count_if(c).alias(f"_n_{k}") for k, c in inside.items()],
        *[exact_sum(F.when(c, F.col("liters"))).alias(f"_l_{k}") for k, c in inside.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("range"), F.lit(p.start).cast("timestamp_ntz").alias("start"),
                              F.lit(p.end).cast("timestamp_ntz").alias("end"), F.col(f"_n_{k}").alias("entries"),
                              round6(f"_l_{k}").alias("liters")) for k, p in ranges.items()])
    return g.select(KEY, F.inline(rows)).filter("entries > 0")


# --- sources, stores and display -----------------------------------------------

def csv_round_trip(spark, d):
    """``fx_dirty`` written as CSV files and loaded back: the clean rows."""
    path = scratch_path(spark, "csv")
    raw = fx.fx_dirty(spark, d).select(*FUEL_RAW_COLUMNS)
    raw.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    good = csvsrc.load_fuel_csv(spark, path).good
    return good.select(TS, "amount_eur", "liters", "fuel_type", "is_full_tank", "station_name", "city", "country")


FILE_CHUNK = 10_000     # row numbers of a chunk of lines


def _three_files(spark, d, columns, name):
    """``fx_dirty`` as three CSV files by order key, one of them with notes over two lines."""
    path = scratch_path(spark, name)
    part = (F.col(ROW) % 3).alias("part")
    notes = F.when((F.col(ROW) % 3 == 1) & (F.col(ROW) % 5 == 0), F.lit('say "one"\nand two,')).otherwise(F.lit("")).alias("notes")
    rows = fx.fx_dirty(spark, d).withColumn("odometer_km", F.col("amount_eur"))
    rows = rows.select(part, F.col(ROW).alias("_at"), *[c for c in columns if c != "notes"], *([notes] if "notes" in columns else []))
    # rows become lines, lines chunks of neighbours: the task that writes a file sorts its chunks, not its rows
    cells = [c for c in rows.columns if c not in ("part", "_at")]
    line = F.to_csv(F.struct(*cells), {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
                                       "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}).alias("line")
    chunks = rows.groupBy("part", F.floor(F.col("_at") / F.lit(FILE_CHUNK)).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_at", line)))["line"].alias("lines"))
    head = rows.select("part").distinct().select("part", F.lit(0).alias("body"), F.lit(None).cast("long").alias("chunk"), F.lit(",".join(cells)).alias("value"))
    text = chunks.select("part", F.lit(1).alias("body"), "chunk", F.array_join("lines", "\n").alias("value")).unionByName(head)
    text.repartition("part").sortWithinPartitions("part", "body", "chunk").drop("body", "chunk").write.partitionBy("part").text(path)
    return path


def _file_part(c="source_file"):
    return F.regexp_extract(c, "/(part=[0-9]+)/", 1)


def csv_files(spark, d):
    """The clean rows of three files, quoted newlines included, by file and number."""
    path = _three_files(spark, d, FUEL_RAW_COLUMNS, "csv-files")
    good = csvsrc.with_source(csvsrc.load_fuel_csv(spark, path).good, csvsrc.source_files(spark, path))
    return good.select(_file_part().alias("file"), "record", TS, "amount_eur", "liters", "country", "notes")


def csv_file_issues(spark, d):
    """The issues of an odometer log in three files: each names its file and row."""
    issues = csvsrc.load_odometer_csv(spark, _three_files(spark, d, ODO_RAW_COLUMNS, "csv-odo")).issues
    rows = issues.filter(F.col(ROW).isNotNull())
    return rows.select(_file_part().alias("file"), F.col(ROW).alias("record"), "severity", "rule", "field", "message")


def csv_missing_columns(spark, d):
    """A log without two of its columns: no row and one issue of the whole file."""
    v = csvsrc.load_fuel_csv(spark, _three_files(spark, d, [c for c in FUEL_RAW_COLUMNS if c not in ("city", "notes")], "csv-missing"))
    kept = v.good.select(F.lit("fuel").alias("dataset"), F.lit("none").alias("severity"), F.lit("row").alias("rule"), F.col("notes").alias("message"))
    return v.issues.select("dataset", "severity", "rule", "message").unionByName(kept)


def _tied(spark, d):
    """Readings dated to their day and numbered 0 to 2: most repeat a time and a number."""
    return fx.fx_odo_raw(spark, d).withColumns({TS: F.date_trunc("day", F.col(TS)).cast("timestamp_ntz"), ROW: F.col(ROW) % 3})


def tied_deltas(spark, d):
    """Distance to the previous reading in the total order of readings that repeat time and number."""
    return dist.with_delta(_tied(spark, d)).select(KEY, TS, ROW, "odometer_km", round6("km_since_last_entry").alias("km_since_last_entry"))


def tied_odometer_at(spark, d):
    """Odometer at each purchase among such readings."""
    e = odometer_at(fx.fx_fuel(spark, d).select(KEY, TS, ROW), _tied(spark, d))
    return e.select(KEY, TS, ROW, round6("odometer.value").alias("odometer_km"), F.col("odometer.quality").alias("quality"),
                    F.col("odometer.source_interval").alias("source_interval"))


def store_round_trip(spark, d):
    """Purchases stored by month and read back for a period."""
    path = scratch_path(spark, "store")
    store.write_log(fx.fx_fuel(spark, d).select(*FUEL_SCHEMA.names), path)
    back = csvsrc.table_rows_to_fuel(store.read_log(spark, path, PERIOD, schema=FUEL_SCHEMA))
    return back.select(KEY, ROW, TS, "amount_eur", "liters", "price_per_liter_eur", "city", "is_full_tank")


def vehicle_reads(spark, d):
    """The purchases of some vehicles, each read by itself from a store of several appended and
    compacted batches (P6, S7)."""
    path = scratch_path(spark, "vehicles")
    fuel = fx.fx_fuel(spark, d).select(*FUEL_SCHEMA.names)
    for third in range(3):
        store.write_log(fuel.filter(F.col(ROW) % 3 == third), path)
        if third == 1:
            store.compact_log(spark, path)
    parts = [store.read_log(spark, path, vehicle=v) for v in VEHICLES]
    return functools.reduce(DataFrame.unionByName, parts).select(KEY, ROW, TS, "amount_eur", "liters")


def append_once(spark, d):
    """Form entries appended in two batches, the first of them twice: what is stored."""
    path = scratch_path(spark, "append")
    raw = fx.fx_dirty(spark, d).withColumnRenamed("datetime", "entry_date")
    halves = [raw.filter(F.col(ROW) % 2 == i) for i in (0, 1)]
    for part in (halves[0], halves[1], halves[0].orderBy(ROW)):
        store.append_entries(spark, part, path)
    return store.read_log(spark, path).select(KEY, ROW, TS, "amount_eur", "liters", "country", "is_full_tank")


def fleet_overview(spark, d):
    """All cities of all vehicles as one ranked list (A12 with no key)."""
    return agg.location_overview(fx.fx_log(spark, d), "city", []).select(
        "city", "stops", *_r6("liters", "eur", "avg_price_per_liter"), "rank")


def import_counts(spark, d):
    """Backfill of a store that holds the first days: imported rows of either log, twice."""
    fuel, odo = fx.fx_fuel(spark, d).select(*FUEL_SCHEMA.names), fx.fx_odo(spark, d).select(*ODO_SCHEMA.names)
    base = scratch_path(spark, "import")
    for df, name in ((fuel, "fuel"), (odo, "odo")):
        store.write_log(df.filter(F.col(TS) < F.lit(IMPORT_CUTOFF).cast("timestamp_ntz")), f"{base}/{name}")
    first = store.import_if_empty(spark, fuel, odo, f"{base}/fuel", f"{base}/odo")
    again = store.import_if_empty(spark, fuel, odo, f"{base}/fuel", f"{base}/odo")
    rows = [("fuel", first[0], again[0]), ("odometer", first[1], again[1])]
    return spark.createDataFrame(rows, "log string, imported long, imported_again long")


def fuel_derived(spark, d):
    """Price and computed amount of each purchase, and its display texts."""
    f = agg.with_derived(fx.fx_fuel(spark, d))
    return f.select(KEY, ROW, "price_per_liter_eur", "computed_amount", F.date_format(TS, "yyyy-MM").alias("month_text"),
                    fixed("liters", 1).alias("liters_text"))


def location_table(spark, d):
    """The country overview under its display headers."""
    o = agg.location_overview(fx.fx_log(spark, d), "country").drop("rank")
    t = agg.overview_table(o, "country")
    return t.select(KEY, *[round6(c).alias(c.replace(" ", "_")) if c in ("Liters", "EUR", "Avg price per liter (EUR)")
                           else F.col(c) for c in t.columns if c != KEY]).withColumnRenamed("Avg_price_per_liter_(EUR)", "Avg_price")


# --- report and payload -----------------------------------------------------

def report_cards(spark, d):
    c = report.report_cards(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), PERIOD)
    return c.select(KEY, "section", "position", "metric", round6("value").alias("value"), "unit", "tone", "note")


def summary_all(spark, d):
    s = report.summary_all(fx.fx_fuel(spark, d), fx.fx_odo(spark, d))
    return s.select(KEY, "entries", *_r6("total_liters", "total_eur", "avg_price_per_liter"), "readings",
                    *_r6("total_km"), "segments", *_r6("avg_l_per_100km", "avg_cost_per_100km"))


def analysis_metrics(spark, d):
    period = resolve_range("custom", AS_OF, *CUSTOM)
    m = report.analysis_metrics(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), period)
    return m.select(KEY, *_r6("total_liters", "total_eur", "avg_price_per_liter"), "entries",
                    *_r6("avg_l_per_100km", "avg_cost_per_100km"))


def analysis_payload(spark, d):
    period = resolve_range("custom", AS_OF, *CUSTOM)
    p = report.analysis_payload(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), period)
    return p.select(KEY, "range", "start", "end",
                    F.size("charts.price_trend").alias("n_price_trend"),
                    F.size("charts.monthly_liters").alias("n_monthly_liters"),
                    F.size("charts.monthly_spending").alias("n_monthly_spending"),
                    F.size("charts.fuel_type_summary").alias("n_fuel_types"),
                    F.size("charts.country_breakdown").alias("n_countries"),
                    F.col("consumption_points").alias("n_consumption"),
                    F.col("metrics.entries").alias("entries"))


def consumption_series(spark, d):
    c = consumption_estimates(fx.fx_fuel(spark, d), fx.fx_odo(spark, d))
    return _series(c).select(KEY, ROW, "datetime", round6("liters_per_100km").alias("liters_per_100km"), "quality")


def payload_series(spark, d):
    """The six chart series of the analysis view in long form, by value."""
    period = resolve_range("custom", AS_OF, *CUSTOM)
    series = report.analysis_series(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), period)
    label = {"price_trend": ("month", "avg_price_per_liter"), "monthly_liters": ("month", "value"),
             "monthly_spending": ("month", "value"), "fuel_type_summary": ("fuel_type", "total_eur"),
             "country_breakdown": ("country", "avg_price_per_liter"), "consumption_series": ("datetime", "liters_per_100km")}
    parts = [series[n].select(KEY, F.lit(n).alias("series"), F.col(at).cast("string").alias("label"),
                              round6(v).alias("value")) for n, (at, v) in label.items()]
    return functools.reduce(DataFrame.unionByName, parts)


_CUSTOM_PERIOD = resolve_range("custom", AS_OF, *CUSTOM)
_JSON = """range STRING, range_label STRING, start STRING, end STRING,
  metrics STRUCT<total_liters DOUBLE, total_eur DOUBLE, avg_price_per_liter DOUBLE, entries BIGINT, avg_l_per_100km DOUBLE, avg_cost_per_100km DOUBLE>,
  charts STRUCT<price_trend ARRAY<STRUCT<month STRING, avg_price_per_liter DOUBLE>>, monthly_liters ARRAY<STRUCT<month STRING, value DOUBLE>>,
    monthly_spending ARRAY<STRUCT<month STRING, value DOUBLE>>, fuel_type_summary ARRAY<STRUCT<fuel_type STRING, count BIGINT, total_liters DOUBLE, total_eur DOUBLE>>,
    country_breakdown ARRAY<STRUCT<country STRING, avg_price_per_liter DOUBLE, total_liters DOUBLE>>>"""


def payload_values(spark, d):
    """Every value of the payload's JSON text, parsed back, with its place."""
    p = report.analysis_payload(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), _CUSTOM_PERIOD)
    j = p.select(KEY, F.from_json("payload", _JSON).alias("j")).select(KEY, "j.range_label", "j.metrics", "j.charts.*")
    metrics = ("total_liters", "total_eur", "avg_price_per_liter", "entries", "avg_l_per_100km", "avg_cost_per_100km")
    charts = {"price_trend": ("month", ["avg_price_per_liter"]), "monthly_liters": ("month", ["value"]), "monthly_spending": ("month", ["value"]),
              "fuel_type_summary": ("fuel_type", ["count", "total_liters", "total_eur"]), "country_breakdown": ("country", ["avg_price_per_liter", "total_liters"])}
    number = lambda c: round6(c.cast("double"))
    one = F.array(*[F.struct(F.lit("metrics").alias("part"), F.lit(0).alias("place"), F.col("range_label").alias("label"), F.lit(m).alias("name"),
                             number(F.col("metrics")[m]).alias("value")) for m in metrics])
    parts = [j.select(KEY, F.inline(one))]
    for chart, (label, names) in charts.items():
        at = j.select(KEY, F.posexplode(chart).alias("place", "p"))
        parts.append(at.select(KEY, F.inline(F.array(*[F.struct(F.lit(chart).alias("part"), F.col("place"), F.col("p")[label].alias("label"),
                                                                  F.lit(n).alias("name"), number(F.col("p")[n]).alias("value")) for n in names]))))
    return functools.reduce(DataFrame.unionByName, parts)


def payload_chunks(spark, d):
    """The payload's consumption points, from chunks of at most seven."""
    c = report.payload_chunks(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), _CUSTOM_PERIOD, size=7)
    return c.select(KEY, "chunk", F.size("points").alias("size"), F.posexplode("points").alias("place", "p")).select(
        KEY, "chunk", "size", "place", F.col("p.datetime").alias("datetime"), F.col("p.row_num").alias(ROW),
        round6("p.liters_per_100km").alias("liters_per_100km"), F.col("p.quality").alias("quality"))


def report_rows(spark, d):
    """All fifteen sections of the report, every row and value (K1-K7)."""
    sections = report.build_report(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), PERIOD)
    place = ["stops", "liters", "eur", "avg_price_per_liter", "rank"]
    shown = {"fuel_cards": ("metric", ["value"]), "distance_cards": ("metric", ["value"]), "estimated_cards": ("metric", ["value"]),
             "boundaries": (F.concat_ws(": ", "boundary", "quality", "supporting_data"), ["odometer_km"]),
             "consumption": (ROW, ["estimated_km", "liters_per_100km", "cost_per_100km", "cost_per_km"]), "overview_fuel": (ROW, ["liters"]),
             "overview_distance": (ROW, ["km_since_last_entry"]), "price_over_time": (ROW, ["price_per_liter_eur"]),
             "monthly_liters": (F.date_format("month", "yyyy-MM-dd"), ["liters"]), "monthly_spending": (F.date_format("month", "yyyy-MM-dd"), ["amount_eur"]),
             "fuel_type_summary": ("fuel_type", ["count", "total_liters", "total_eur"]),
             "fuel_type_share": ("fuel_type", ["stops_share_pct", "liters_share_pct", "eur_share_pct"]),
             "country_overview": ("country", place), "city_overview": ("city", place), "odometer_readings": (ROW, ["odometer_km", "km_since_previous"])}
    parts = []
    for name, (label, values) in shown.items():
        label = (F.col(label) if isinstance(label, str) else label).cast("string")
        listed = F.array(*[F.struct(F.lit(v).alias("name"), round6(F.col(v).cast("double")).alias("value")) for v in values])
        parts.append(sections[name].select(KEY, F.lit(name).alias("section"), label.alias("label"), F.inline(listed)))
    return functools.reduce(DataFrame.unionByName, parts)


def report_issue_counts(spark, d):
    """The report's issue counts by dataset and severity, pairs counted."""
    report_part = report.build_report(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), PERIOD, fuel_issues=_tied_duplicates(spark, d).issues)
    return report_part["issue_counts"]


def _tied_duplicates(spark, d):
    """Raw odometer rows on the day, so that equal amounts of a vehicle make several pairs."""
    raw = fx.fx_dirty_odometer(spark, d).withColumns({KEY: F.col(KEY) % 5, "odometer_km": F.lit("100")})
    return rules.validate_odometer(raw, [KEY])


def report_sections(spark, d):
    """Rows and sums of the report's listed sections (K5-K7)."""
    sections = report.build_report(fx.fx_fuel(spark, d), fx.fx_odo(spark, d), PERIOD)
    value = {"consumption": "estimated_km", "overview_fuel": "liters", "overview_distance": "km_since_last_entry",
             "price_over_time": "price_per_liter_eur", "odometer_readings": "odometer_km"}
    parts = [sections[n].groupBy(KEY).agg(F.lit(n).alias("section"), F.count(F.lit(1)).alias("rows"), round6(exact_sum(c)).alias("total"))
             for n, c in value.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def queries() -> dict[str, Query]:
    from fleetlog.streaming import ingest
    return {
        "fuel_totals": fuel_totals,
        "month_to_date": month_to_date,
        "fuel_price_over_time": fuel_price_over_time,
        "fuel_type_summary": fuel_type_summary,
        "fuel_type_share": fuel_type_share,
        "avg_price_by_country": avg_price_by_country,
        "avg_price_by_city": avg_price_by_city,
        "location_overview_country": _overview("country"),
        "location_overview_city": _overview("city"),
        "monthly_liters": monthly_liters,
        "monthly_spending": monthly_spending,
        "fuel_price_trend": fuel_price_trend,
        "total_distance": total_distance,
        "total_distance_raw": total_distance_raw,
        "monthly_km_driven": monthly_km_driven,
        "cumulative_distance": cumulative_distance,
        "distance_timeline": distance_timeline,
        "odometer_readings_in_period": odometer_readings_in_period,
        "odometer_at_fuel": odometer_at_fuel,
        "consumption_segments": consumption_segments,
        "consumption_flat": consumption_flat,
        "consumption_summary": consumption_summary,
        "consumption_in_period": consumption_in_period,
        "distance_between": distance_between_q,
        "distance_between_raw": distance_between_raw,
        "boundary_estimates": boundary_estimates,
        "fuel_clean": fuel_clean,
        "fuel_issues": fuel_issues,
        "issue_summary": issue_summary,
        "fuel_duplicates": fuel_duplicates,
        "odometer_clean": odometer_clean,
        "odometer_issues": odometer_issues,
        "quality_summary": quality_summary,
        "odometer_monotonicity": odometer_monotonicity,
        "odometer_duplicates": odometer_duplicates,
        "entry_validation": entry_validation,
        "recent_history": recent_history,
        "country_lookup": country_lookup,
        "unknown_countries": unknown_countries,
        "country_options": country_options,
        "vehicles_for_user": vehicles_for_user,
        "import_missing_vehicles": import_missing_vehicles,
        "report_period": report_period,
        "range_bounds": range_bounds,
        "report_cards": report_cards,
        "summary_all": summary_all,
        "analysis_metrics": analysis_metrics,
        "analysis_payload": analysis_payload,
        "stream_month_to_date": ingest.stream_month_to_date_query,
        "stream_ingest": ingest.stream_ingest_query,
        "stream_entries": ingest.stream_entries_query,
        "csv_round_trip": csv_round_trip,
        "csv_files": csv_files,
        "csv_file_issues": csv_file_issues,
        "csv_missing_columns": csv_missing_columns,
        "tied_deltas": tied_deltas,
        "tied_odometer_at": tied_odometer_at,
        "store_round_trip": store_round_trip,
        "import_counts": import_counts,
        "vehicle_reads": vehicle_reads,
        "append_once": append_once,
        "fleet_overview": fleet_overview,
        "fuel_derived": fuel_derived,
        "location_table": location_table,
        "consumption_series": consumption_series,
        "payload_series": payload_series,
        "report_sections": report_sections,
        "payload_values": payload_values,
        "payload_chunks": payload_chunks,
        "report_rows": report_rows,
        "report_issue_counts": report_issue_counts,
    }
