"""Lookups, membership tests, history top-k and periods.

Joins with dimensions carry no hint: the planner and AQE broadcast a side whose
size in bytes they know to be small, and shuffle otherwise.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period, normalize_boundary
from fleetlog.functions.text import iso_text
from fleetlog.schema import COUNTRIES, KEY, PRIMARY_COUNTRY_CODES, ROW, TS


def countries_dimension(spark: SparkSession) -> DataFrame:
    """The fixed country list as a two-column dimension ``(code, name)``."""
    return spark.createDataFrame(list(COUNTRIES), "code string, name string")


def with_country_name(df: DataFrame, dim: DataFrame, code: str = "country", out: str = "country_name") -> DataFrame:
    """``name`` of the code from the dimension; a miss keeps the code itself."""
    d = dim.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    joined = df.join(d, df[code] == d["_code"], "left")
    return joined.withColumn(out, F.coalesce("_name", F.col(code))).drop("_code", "_name")


def known_codes(df: DataFrame, dim: DataFrame, code: str = "country", known: bool = True) -> DataFrame:
    """Rows whose code is (``known=True``) or is not in the dimension (J4): semi / anti join."""
    d = dim.select(F.col("code").alias("_code"))
    return df.join(d, df[code] == d["_code"], "left_semi" if known else "left_anti")


def ordered_options(dim: DataFrame, primary=PRIMARY_COUNTRY_CODES) -> DataFrame:
    """Dimension rows with ``position``: primary codes in their fixed order, then the
    rest by name (O5)."""
    pos = F.array_position(F.array(*[F.lit(p) for p in primary]), F.col("code"))
    order_key = F.coalesce(F.nullif(pos, F.lit(0)), F.lit(len(primary) + 1))
    return dim.withColumn("position", F.row_number().over(Window.orderBy(order_key, F.col("name"), F.col("code"))))


def vehicles_for_user(users: DataFrame, bridge: DataFrame, vehicles: DataFrame,
                      user_key: str = "user_id", vehicle_key: str = "car_id", role: str | None = None) -> DataFrame:
    """Users joined through the many-to-many bridge to their vehicles."""
    b = bridge if role is None else bridge.filter(F.col("role") == role)
    return users.join(b, user_key).join(vehicles, vehicle_key)


def import_missing(incoming: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``incoming`` for keys that have no rows in ``target`` yet."""
    keys = [KEY] if keys is None else list(keys)
    return incoming.join(target.select(*keys).distinct(), keys, "left_anti")


def fetch_entries(fuel: DataFrame, start: datetime | None = None, end: datetime | None = None,
                  limit: int | None = None, keys: list[str] | None = None, ascending: bool = False,
                  ordered: bool = False) -> DataFrame:
    """A key's entries, optional inclusive bounds and per-key limit (O1-O3).

    ``ordered`` sorts the result by key and time, newest first or ``ascending``, for a
    sink that shows it; the limit keeps the newest either way.

    The per-key limit is a ``row_number <= k`` filter, which Spark plans as a
    window group limit: every task keeps at most ``k`` rows per key before the
    shuffle, so a hot key costs ``k`` rows per task, not its whole history.
    """
    keys = [KEY] if keys is None else list(keys)
    out = fuel
    if start is not None:
        out = out.filter(F.col(TS) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col(TS) <= F.lit(end).cast("timestamp_ntz"))
    if limit is not None:
        w = Window.partitionBy(*keys).orderBy(F.col(TS).desc(), F.col(ROW).desc())
        out = out.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= limit)
    if ordered:
        order = [F.col(c).asc() if ascending else F.col(c).desc() for c in (TS, ROW)]
        out = out.orderBy(*keys, *order)
    return out


HISTORY_LIMIT = 30   # rows shown in the recent-history list


def recent_history(fuel: DataFrame, k: int = HISTORY_LIMIT, keys: list[str] | None = None) -> DataFrame:
    """The ``k`` newest entries per key (O2) as display rows."""
    return entry_view(fetch_entries(fuel, limit=k, keys=keys), keys=keys)


def entry_view(fuel: DataFrame, dim: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """History row for display: ISO datetime, date, HH:MM, country name."""
    keys = [KEY] if keys is None else list(keys)
    cols = [*keys, ROW, iso_text(TS).alias("datetime"), F.date_format(TS, "yyyy-MM-dd").alias("date"),
            F.date_format(TS, "HH:mm").alias("time")]
    rest = [c for c in ("station_name", "city", "country", "liters", "amount_eur", "fuel_type", "is_full_tank",
                        "recency") if c in fuel.columns]
    out = fuel.select(*cols, *rest)
    if dim is not None and "country" in fuel.columns:
        out = with_country_name(out, dim)
    return out


def log_bounds(fuel: DataFrame, odo: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Earliest and latest timestamp over both logs per key."""
    keys = [KEY] if keys is None else list(keys)
    both = fuel.select(*keys, TS).unionByName(odo.select(*keys, TS))
    return both.groupBy(*keys).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


def resolve_report_periods(fuel: DataFrame, odo: DataFrame, start: date | datetime | None = None,
                           end: date | datetime | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per key inclusive ``(start, end)``: defaults from both logs, dates widened to
    whole days; a key whose start is after its end fails the query (D3, D4)."""
    keys = [KEY] if keys is None else list(keys)
    s = normalize_boundary(start, None, is_end=False)
    e = normalize_boundary(end, None, is_end=True)
    b = log_bounds(fuel, odo, keys)
    s_col = F.lit(s).cast("timestamp_ntz") if s is not None else F.col("first_ts")
    e_col = F.lit(e).cast("timestamp_ntz") if e is not None else F.col("last_ts")
    checked = F.when(s_col > e_col, F.raise_error(F.lit("Report start date must not be after the end date."))) \
        .otherwise(s_col)
    return b.select(*keys, checked.alias("start"), e_col.alias("end"))


def report_period(fuel: DataFrame, odo: DataFrame, start: date | datetime | None = None,
                  end: date | datetime | None = None) -> Period:
    """Single-period form (all rows as one log): one action for two scalars."""
    row = log_bounds(fuel, odo, []).first()
    if row is None or row["first_ts"] is None:
        raise ValueError("Cannot generate a report without any fuel or odometer records.")
    s = normalize_boundary(start, row["first_ts"], is_end=False)
    e = normalize_boundary(end, row["last_ts"], is_end=True)
    if s > e:
        raise ValueError("Report start date must not be after the end date.")
    return Period(s, e)
