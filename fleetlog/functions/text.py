"""Text, number and timestamp column helpers.

Every helper returns a Column built from Spark built-ins so that it stays
inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# ISO-8601 date or date-time without a zone: what the loaders accept.
ISO_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?$"
# Decimal literal as read by Python's float(): optional sign, digits with
# single underscores between them, optional fraction and exponent.
_DIGITS = r"[0-9](_?[0-9])*"
NUMBER_PATTERN = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character Python's str.strip() removes (str.isspace() is true), by rule.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(c: ColumnLike) -> Column:
    """Strip leading/trailing whitespace like Python's ``str.strip()``.

    Spark's one-argument ``trim`` removes spaces only; the two-argument form
    with the full whitespace set is a native character scan (no regex)."""
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


def parse_iso_timestamp(c: ColumnLike, stripped: bool = False) -> Column:
    """ISO text -> TIMESTAMP_NTZ, null when it is not a valid local date-time.

    The text is whitespace-stripped first unless ``stripped`` says it already is."""
    s = _col(c) if stripped else strip_ws(c)
    return F.when(s.rlike(ISO_TIMESTAMP_PATTERN),
                  F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))


def parse_number(c: ColumnLike, stripped: bool = False) -> Column:
    """Decimal text -> DOUBLE, null when not a finite decimal literal."""
    s = _col(c) if stripped else strip_ws(c)
    return F.when(s.rlike(NUMBER_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def epoch_micros(c: ColumnLike) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (``unix_micros`` refuses NTZ)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(c))


def ts_text_sql(e: str, sep: str = " ") -> str:
    """SQL text of ``ts_text`` for a column / field path ``e``."""
    return (f"concat(date_format({e}, 'yyyy-MM-dd''{sep}''HH:mm:ss'), CASE WHEN date_format({e}, 'SSSSSS') <> '000000' "
            f"THEN concat('.', date_format({e}, 'SSSSSS')) ELSE '' END)")


def ts_text(c: ColumnLike, sep: str = " ") -> Column:
    """A timestamp as Python prints it: seconds always, microseconds only when non-zero.

    ``c`` may be a column name or field path (``"_prev.ts"``) or a Column."""
    if isinstance(c, str):
        return F.expr(ts_text_sql(c, sep))
    t = c
    frac = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, f"yyyy-MM-dd'{sep}'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def iso_text(c: ColumnLike) -> Column:
    """``datetime.isoformat()`` text (``T`` separator)."""
    return ts_text(c, "T")


EPOCH_MICROS_SQL = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def round6(c: ColumnLike) -> Column:
    """Six-decimal half-up rounding by plain IEEE arithmetic, ``floor(x*1e6 + 0.5) / 1e6``.

    Spark's ``round`` rounds the shortest decimal text of a double, SQL engines
    usually the binary value; this formula gives the same result for the same
    double everywhere (used where results are compared across engines)."""
    x = _col(c)
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def exact_sum(c: ColumnLike, places: int = 9) -> Column:
    """Sum of doubles that does not depend on their order: added up as decimals with
    ``places`` places (up to 15), turned into a double once at the end."""
    return F.sum(_col(c).cast(f"decimal({19 + places if places < 10 else 38},{places})")).cast("double")


def fixed(c: ColumnLike, places: int) -> Column:
    """Fixed-decimal display text (F9) as Python's ``f"{x:.1f}"`` gives it, e.g.
    ``fixed(liters, 1)`` -> ``'42.5'``: the binary value, rounded half to even.

    Below 1024 in size the value is scaled by a power of two, which is exact from 2^-10 on,
    and rounded in whole numbers; beyond, its shortest decimal text is rounded.  Numbers
    stay numeric in every dataset, this is only for text sinks."""
    x, unit = _col(c), 10 ** int(places)
    size = F.when(F.abs(x) < 1024, F.abs(x))
    scale = F.when(size < 1, F.lit(2 ** 62)).otherwise(F.lit(2 ** 52))
    whole = (size * scale.cast("double")).cast("long").cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)")
    one = scale.cast("decimal(20,0)")
    quotient = F.floor(whole / one)
    quotient = F.when(quotient * one > whole, quotient - 1).otherwise(quotient)  # the division rounds
    twice = (whole - quotient * one) * 2
    rounded = F.when((twice > one) | ((twice == one) & (quotient % 2 == 1)), quotient + 1).otherwise(quotient)
    near = (rounded.cast("decimal(30,0)") / F.lit(unit).cast("decimal(10,0)")).cast(f"decimal(30,{int(places)})").cast("string")
    far = F.bround(x.cast("decimal(38,15)"), int(places)).cast(f"decimal(38,{int(places)})").cast("string")
    return F.when(F.abs(x) < 1024, F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), near)).otherwise(far)


def py_float(c: ColumnLike) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, where Spark
    changes to an exponent at 1e-3 and 1e7."""
    x = _col(c)
    text = x.cast("string")
    inside = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16)
    plain = F.rtrim(F.when(inside, text.try_cast("decimal(38,17)")).cast("string"), F.lit("0"))
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(text.contains("E") & inside, plain).otherwise(text)
