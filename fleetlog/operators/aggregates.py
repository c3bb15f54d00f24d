"""Fuel-log aggregates (A1-A14): totals, breakdowns, location overviews and
calendar-month series.

All are ``groupBy`` aggregations (partial + final, map-side combine), so a
hot vehicle is pre-aggregated in every task before the shuffle.  Windows
only run over the already aggregated, small per-key tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period, month_bounds, month_end_label
from fleetlog.functions.text import exact_sum, strip_ws
from fleetlog.schema import KEY, TS
from fleetlog.session import checkpoint_dir


def _keys(keys):
    return [KEY] if keys is None else list(keys)


def _sum0(c: str) -> Column:
    return F.coalesce(exact_sum(c), F.lit(0.0))


def _weighted_price(eur: Column, liters: Column) -> Column:
    """Volume-weighted price, 0.0 when there are no litres."""
    return F.coalesce(F.try_divide(eur, liters), F.lit(0.0))


def fuel_totals(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries, litres, EUR and volume-weighted price per key (A1-A4)."""
    k = _keys(keys)
    return (fuel.groupBy(*k).agg(F.count(F.lit(1)).alias("entries"),
                                 _sum0("liters").alias("total_liters"),
                                 _sum0("amount_eur").alias("total_eur"))
            .withColumn("avg_price_per_liter", _weighted_price(F.col("total_eur"), F.col("total_liters"))))


def month_to_date(fuel: DataFrame, as_of: datetime, keys: list[str] | None = None) -> DataFrame:
    """Litres and EUR in the calendar month containing ``as_of``."""
    start, end = month_bounds(as_of)
    k = _keys(keys)
    return (fuel.filter(Period(start, end).contains(TS)).groupBy(*k)
            .agg(_sum0("liters").alias("month_liters"), _sum0("amount_eur").alias("month_eur"),
                 F.count(F.lit(1)).alias("month_entries"))
            .withColumn("month_start", F.lit(start).cast("timestamp_ntz")))


def with_derived(fuel: DataFrame) -> DataFrame:
    """Derived per-purchase columns: ``price_per_liter_eur = amount / liters`` (P1) and
    ``computed_amount = liters * price`` (P2; equals the amount by construction)."""
    price = F.try_divide(F.col("amount_eur"), F.col("liters"))
    return fuel.withColumns({"price_per_liter_eur": price, "computed_amount": F.col("liters") * price})


def fuel_price_over_time(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Price per litre at each purchase."""
    return fuel.select(*_keys(keys), TS, *([c for c in ("row_num",) if c in fuel.columns]),
                       F.try_divide("amount_eur", "liters").alias("price_per_liter_eur"))


def fuel_type_summary(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, litres and EUR per fuel type (A5)."""
    k = _keys(keys)
    return fuel.groupBy(*k, "fuel_type").agg(F.count(F.lit(1)).alias("count"),
                                              exact_sum("liters").alias("total_liters"),
                                              exact_sum("amount_eur").alias("total_eur"))


def fuel_type_share(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Percentage of stops, litres and EUR of each fuel type within its key.

    Null share when the key's total is 0 ("No data")."""
    k = _keys(keys)
    return shares(fuel_type_summary(fuel, k), k)


def shares(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The shares of a fuel-type summary; its rows are few, one per key and type."""
    w = Window.partitionBy(*keys)
    out = summary
    for c, name in (("count", "stops"), ("total_liters", "liters"), ("total_eur", "eur")):
        out = out.withColumn(f"{name}_share_pct",
                             F.try_divide(F.col(c) * 100.0, F.sum(c).over(w).cast("double")))
    return out


def avg_price_by_country(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Volume-weighted price and litres per country."""
    k = _keys(keys)
    return (fuel.groupBy(*k, "country").agg(exact_sum("amount_eur").alias("_eur"), exact_sum("liters").alias("total_liters"))
            .select(*k, "country", F.try_divide("_eur", "total_liters").alias("avg_price_per_liter"), "total_liters"))


def avg_price_by_city(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """As ``avg_price_by_country`` per city, blank cities removed.

    Grouping is on the unstripped city value."""
    k = _keys(keys)
    return (fuel.filter(strip_ws("city") != "")
            .groupBy(*k, "city").agg(exact_sum("amount_eur").alias("_eur"), exact_sum("liters").alias("total_liters"))
            .select(*k, "city", F.try_divide("_eur", "total_liters").alias("avg_price_per_liter"), "total_liters"))


# Display headers of the location overview table (fixed values of the original report).
OVERVIEW_HEADERS = {"stops": "Stops", "liters": "Liters", "eur": "EUR", "avg_price_per_liter": "Avg price per liter (EUR)"}


def overview_table(overview: DataFrame, column: str) -> DataFrame:
    """Location overview with display headers: title-cased label column (F10) and the
    report's column names, values kept numeric."""
    out = overview.withColumnRenamed(column, column.title())
    for src, dst in OVERVIEW_HEADERS.items():
        out = out.withColumnRenamed(src, dst)
    return out


def location_overview(fuel: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Stops, litres, EUR and weighted price per country or city, ranked by
    litres desc, stops desc (A12, O4).  ``rank`` makes the order explicit."""
    k = _keys(keys)
    src = fuel.filter(strip_ws(column) != "") if column == "city" else fuel
    g = (src.groupBy(*k, column).agg(F.count(F.lit(1)).alias("stops"), exact_sum("liters").alias("liters"),
                                     exact_sum("amount_eur").alias("eur"))
         .withColumn("avg_price_per_liter", F.try_divide("eur", "liters")))
    return ranked(g, column, k)


def ranked(overview: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``overview`` with ``rank`` by litres desc, stops desc, name.

    Per key a window ranks the key's places.  With ``keys=[]`` all places are one list, which is
    ranked by ranges of that order: inside a range by a window, plus the rows of the ranges
    before it; so no task holds all places.  The driver sees one count for each range."""
    order = [F.col("liters").desc(), F.col("stops").desc(), F.col(column)]
    if keys:
        return overview.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    checkpoint_dir(overview.sparkSession)
    # stored, so that the counts and the rows see one division into ranges
    ranges = overview.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    before, offsets = 0, {}
    for r in sorted(ranges.groupBy("_range").count().collect()):
        offsets[r["_range"]] = before
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    if not offsets:
        return ranges.withColumn("rank", place).drop("_range")
    ahead = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("_range")]
    return ranges.withColumn("rank", (place + ahead).cast("int")).drop("_range")


def _monthly(fuel: DataFrame, k: list[str], value: Column, fill: Column | None) -> DataFrame:
    """Month-end series with every month between the key's first and last event.

    Gaps are filled on the aggregated table: each month is repeated up to the one
    before the key's next month, so the log is read and shuffled once."""
    g = fuel.groupBy(*k, F.trunc(F.col(TS).cast("date"), "month").alias("_m")).agg(value.alias("_v"))
    return fill_months(g, k, {"_v": fill})


def fill_months(months: DataFrame, keys: list[str], fills: dict[str, Column | None]) -> DataFrame:
    """``keys, month`` (month-end label) and the columns of ``fills`` for every month between
    the first and last ``_m`` of a key; in gaps a column has its fill (None: null)."""
    following = F.lead("_m").over(Window.partitionBy(*keys).orderBy("_m"))
    upto = F.coalesce(F.add_months(following, -1), F.col("_m"))
    filled = months.withColumn("_upto", upto).select(
        *keys, "_m", *fills, F.explode(F.sequence("_m", "_upto", F.expr("INTERVAL 1 MONTH"))).alias("_at"))
    own = F.col("_at") == F.col("_m")

    def value(c: str, fill: Column | None) -> Column:
        there = F.when(own, F.col(c))
        return (there if fill is None else there.otherwise(fill)).alias(c)
    return filled.select(*keys, month_end_label("_at").alias("month"), *[value(c, fill) for c, fill in fills.items()])


def monthly_liters(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Litres per month-end label, gap months 0.0 (A10)."""
    return _monthly(fuel, _keys(keys), exact_sum("liters"), F.lit(0.0)).withColumnRenamed("_v", "liters")


def monthly_spending(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """EUR per month-end label, gap months 0.0 (A10)."""
    return _monthly(fuel, _keys(keys), exact_sum("amount_eur"), F.lit(0.0)).withColumnRenamed("_v", "amount_eur")


def fuel_price_trend(fuel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unweighted mean price per month-end label; gap months null."""
    price = F.try_divide(F.col("amount_eur"), F.col("liters"))
    mean = F.try_divide(exact_sum(price), F.count(price))
    return _monthly(fuel, _keys(keys), mean, None).withColumnRenamed("_v", "avg_price_per_liter")
