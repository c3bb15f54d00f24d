"""Fuel and odometer views over the driver's benchmark tables.

The driver tables are not fuel logs, so each view maps one of them onto the
fuel/odometer schemas (see FIXTURES.md for the DuckDB twins).  They are plain
projections, filters and joins so that Catalyst prunes columns and pushes
filters into the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.operators.sequence import running_total
from fleetlog.schema import KEY, ROW, TS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias(KEY), F.col("ts").alias(TS), F.col("event_id").alias(ROW),
        "event_type", "value", "props")


def fx_fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as refuels: amount = value, litres = 1 + props.k; type, station,
    city and country derived from props.k so that breakdowns have groups."""
    k = F.get_json_object("props", "$.k").cast("long")
    return (_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
            .select(KEY, TS, ROW, F.col("value").alias("amount_eur"), (k.cast("double") + 1).alias("liters"),
                    F.when(k % 3 == 0, F.lit("E5")).otherwise(F.lit("E10")).alias("fuel_type"),
                    F.lit("true").alias("is_full_tank"),
                    F.concat(F.lit("Station "), (k % 7).cast("string")).alias("station_name"),
                    F.concat(F.lit("City "), (k % 5).cast("string")).alias("city"),
                    F.when(k % 3 == 0, F.lit("DE")).when(k % 3 == 1, F.lit("AT")).otherwise(F.lit("IT")).alias("country"),
                    F.lit("").alias("notes"))
            .withColumn("price_per_liter_eur", F.try_divide("amount_eur", "liters")))


def fx_odo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: running decimal sum of ``value`` over all of a user's events,
    kept on view/click/error events and on every fifth purchase (exact matches)."""
    ev = _events(spark, sf_dir).select(KEY, TS, ROW, "event_type", "value")
    ev = running_total(ev, [KEY], F.col("value").cast("decimal(18,2)"), "_km")
    keep = (F.col("event_type").isin("view", "click", "error")
            | ((F.col("event_type") == "purchase") & (F.col(ROW) % 5 == 0)))
    return ev.filter(keep).select(KEY, TS, ROW, F.col("_km").cast("double").alias("odometer_km"),
                                  F.lit("").alias("notes"))


def fx_odo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reading of ``value`` km (not monotone)."""
    return _events(spark, sf_dir).select(KEY, TS, ROW, F.col("value").alias("odometer_km"),
                                         F.lit("").alias("notes"))


def fx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long purchase history: line items per supplier (vehicle), day-granular."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    return (li.join(su, li.l_suppkey == su.s_suppkey)
            .join(na, su.s_nationkey == na.n_nationkey)
            .select(F.col("l_suppkey").alias(KEY), F.col("l_shipdate").alias(TS),
                    F.col("l_extendedprice").alias("amount_eur"), F.col("l_quantity").alias("liters"),
                    F.try_divide("l_extendedprice", "l_quantity").alias("price_per_liter_eur"),
                    F.col("l_returnflag").alias("fuel_type"),
                    F.when(F.col("l_linestatus") == "F", "true").otherwise("false").alias("is_full_tank"),
                    F.col("s_name").alias("station_name"),
                    F.when(F.col("s_suppkey") % 10 == 0, " ").otherwise(F.col("s_name")).alias("city"),
                    F.col("n_name").alias("country")))


def fx_gap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_log`` with the rows of February and August dated 31 days later, so that every
    supplier has months without a row."""
    moved = F.when(F.month(TS).isin(2, 8), F.col(TS) + F.expr("INTERVAL 31 DAYS")).otherwise(F.col(TS))
    return fx_log(spark, sf_dir).withColumn(TS, moved)


def fx_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw all-string fuel rows of vehicles (customers), rendered from ``orders`` with
    deterministic faults."""
    return dirty_rows(table(spark, sf_dir, "orders"))


def _round2_binary(x):
    """Two-decimal rounding of the binary double, half away from zero (the SQL twin's
    ``round``): scale, then compare the exact fractional part with one half.  Spark's
    ``round`` would round the shortest decimal text instead (36.245 -> 36.25, while the
    double 36.2449999... rounds to 36.24)."""
    v = x * F.lit(100.0)
    frac = F.abs(v) - F.floor(F.abs(v))
    mag = F.when(frac >= 0.5, F.ceil(F.abs(v))).otherwise(F.floor(F.abs(v))).cast("double")
    return F.when(v < 0, -mag).otherwise(mag) / F.lit(100.0)


def dirty_rows(o: DataFrame) -> DataFrame:
    """The ``fx_dirty`` projection of an ``orders`` frame (batch or streaming)."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: F.lit(x)
    return o.select(
        c.alias(KEY), (k + 2).alias(ROW),
        F.when(k % 97 == 0, s("not-a-date")).when(k % 89 == 0, s(""))
        .otherwise(F.concat(s(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), s(" "))).alias("datetime"),
        F.when(k % 83 == 0, s("-10")).when(k % 79 == 0, s("abc"))
        .otherwise(_round2_binary(F.col("o_totalprice") / 3000).cast("string")).alias("amount_eur"),
        F.when(k % 73 == 0, s("0")).otherwise((20 + c % 40).cast("string")).alias("liters"),
        F.when(k % 71 == 0, s("E15")).when(F.col("o_orderstatus") == "F", s("E5")).otherwise(s("E10")).alias("fuel_type"),
        F.when(k % 11 == 0, s("")).when(k % 11 == 1, s("NO")).when(k % 11 == 2, s("na"))
        .when(k % 11 == 3, F.when(k % 5 == 0, s("maybe")).otherwise(s("1"))).otherwise(s("true")).alias("is_full_tank"),
        F.when(k % 67 == 0, s("  ")).otherwise(F.concat(s("Station "), (c % 50).cast("string"))).alias("station_name"),
        F.when(k % 61 == 0, s("")).otherwise(F.concat(s("City "), (c % 20).cast("string"))).alias("city"),
        F.when(k % 13 == 0, s("ES")).when(k % 13 == 1, s("de"))
        .when(k % 13 == 2, F.when(k % 17 == 0, s("Germany")).otherwise(s("FR"))).otherwise(s("DE")).alias("country"),
        s("").alias("notes"),
    )


def fx_dirty_odometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw odometer rows: ``fx_dirty`` with its amount column read as the odometer."""
    return fx_dirty(spark, sf_dir).select(
        KEY, ROW, "datetime", F.col("amount_eur").alias("odometer_km"), "notes")
