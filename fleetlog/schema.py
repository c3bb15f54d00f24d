"""Schemas, column names and the fixed values the rules depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names shared by every operator.
KEY = "vehicle_id"
TS = "event_ts"
ROW = "row_num"

FUEL_RAW_COLUMNS = ("datetime", "amount_eur", "liters", "fuel_type", "is_full_tank",
                    "station_name", "city", "country", "notes")
ODO_RAW_COLUMNS = ("datetime", "odometer_km", "notes")

FUEL_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType()),
    T.StructField(TS, T.TimestampNTZType()),
    T.StructField("amount_eur", T.DoubleType()),
    T.StructField("liters", T.DoubleType()),
    T.StructField("price_per_liter_eur", T.DoubleType()),
    T.StructField("fuel_type", T.StringType()),
    T.StructField("is_full_tank", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField(ROW, T.LongType()),
])

ODO_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType()),
    T.StructField(TS, T.TimestampNTZType()),
    T.StructField("odometer_km", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField(ROW, T.LongType()),
])

# An estimated value with its provenance.
EST_TYPE = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("quality", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("source_interval", T.StringType()),
])

ISSUE_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField(KEY, T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField(ROW, T.LongType()),
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
])

EXACT, ESTIMATED, INSUFFICIENT = "exact", "estimated", "insufficient"
ERROR, WARNING = "error", "warning"

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the original tool's for identical results.
# ---------------------------------------------------------------------------
ALLOWED_FUEL_TYPES = ("E5", "E10")
PRIMARY_COUNTRY_CODES = ("DE", "AT", "IT", "FR", "HR", "CH")   # display order
COUNTRY_CODE_PATTERN = r"^[A-Z]{2}$"
PRICE_PER_LITER_MIN_WARN = 0.80
PRICE_PER_LITER_MAX_WARN = 3.00
DUPLICATE_TOLERANCE_MINUTES = 20
DEFAULT_INTERPOLATION_METHOD = "linear"
TANK_UNKNOWN_WORDS = ("", "na", "none")
TANK_TRUE_WORDS = ("true", "1", "yes")
TANK_FALSE_WORDS = ("false", "0", "no")
TANK_STATES = ("true", "false", "unknown")
COUNTRIES = (
    ("DE", "Germany"), ("AT", "Austria"), ("IT", "Italy"), ("FR", "France"),
    ("HR", "Croatia"), ("CH", "Switzerland"), ("BE", "Belgium"), ("NL", "Netherlands"),
    ("LU", "Luxembourg"), ("DK", "Denmark"), ("PL", "Poland"), ("CZ", "Czechia"),
    ("SK", "Slovakia"), ("SI", "Slovenia"), ("HU", "Hungary"), ("ES", "Spain"),
    ("PT", "Portugal"), ("SE", "Sweden"), ("NO", "Norway"), ("FI", "Finland"),
    ("GB", "United Kingdom"), ("IE", "Ireland"), ("GR", "Greece"), ("RO", "Romania"),
    ("BG", "Bulgaria"), ("LI", "Liechtenstein"), ("MC", "Monaco"), ("SM", "San Marino"),
    ("ME", "Montenegro"), ("RS", "Serbia"), ("BA", "Bosnia and Herzegovina"),
    ("MK", "North Macedonia"), ("AL", "Albania"), ("TR", "Turkey"),
)
# ---------------------------------------------------------------------------
