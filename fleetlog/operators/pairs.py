"""Rows with equal values within a time tolerance.

``tolerance_groups`` finds them without making pairs: rows are first summed up
by instant (hash aggregate, so an instant or value that a third of all rows
share is one row a task), then each instant looks back over the tolerance
among the instants of its value.  Its output grows with the instants, and pair
counts are arithmetic.  ``tolerance_pairs`` lists the pairs themselves, whose
number is quadratic in a group, for callers that want them.

Null equality values never match; null keys are a key of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.functions.text import epoch_micros
from fleetlog.operators.sequence import key_id
from fleetlog.schema import DUPLICATE_TOLERANCE_MINUTES, ROW, TS

_DAY = 86_400_000_000


def tolerance_groups(df: DataFrame, keys: list[str], equal: list[str], ts: str = TS, row: str = ROW,
                     tolerance_minutes: float = DUPLICATE_TOLERANCE_MINUTES) -> DataFrame:
    """One row for each (keys, equal, instant) with a partner at the same instant or up
    to the tolerance before it.

    Columns: keys, equal, ``ts``, ``rows`` (at the instant), ``first_row`` and ``last_row``
    (smallest and largest row number there), ``earlier_rows`` (in the tolerance before
    it), ``nearest_ts`` and ``nearest_row`` (the nearest earlier instant and its largest
    row number, null without one) and ``pairs`` (unordered pairs whose later row is here).
    """
    tol = int(round(tolerance_minutes * 60_000_000))
    width = max(_DAY, 2 * tol)
    base = df.select(*keys, *equal, ts, row).dropna(subset=[*equal, ts])
    at = base.groupBy(*keys, *equal, ts).agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias("first_row"),
                                             F.max(row).alias("last_row"))
    at = at.withColumns({"_t": epoch_micros(ts), "_kid": key_id(keys)})
    own = F.floor(F.col("_t") / F.lit(width))
    # an instant near the end of its bucket is seen from the next one too
    seen = F.array_compact(F.array(own, F.when(F.pmod("_t", F.lit(width)) >= width - tol, own + 1)))
    spread = at.withColumn("_own", own).withColumn("_tb", F.explode(seen))
    back = Window.partitionBy("_kid", *equal, "_tb").orderBy("_t").rangeBetween(-tol, -1)
    found = spread.withColumns({
        "earlier_rows": F.coalesce(F.sum("rows").over(back), F.lit(0)),
        "nearest_ts": F.max(ts).over(back),
        "nearest_row": F.last("last_row").over(back),
    }).filter(F.col("_tb") == F.col("_own"))
    n = F.col("rows")
    pairs = (n * (n - 1) / 2).cast("long") + n * F.col("earlier_rows")
    return found.withColumn("pairs", pairs).filter(F.col("pairs") > 0).drop("_t", "_kid", "_own", "_tb")


def tolerance_pairs(df: DataFrame, keys: list[str], equal: list[str], ts: str = TS, row: str = ROW,
                    tolerance_minutes: float = DUPLICATE_TOLERANCE_MINUTES,
                    orient: str = "row", carry: list[str] | None = None) -> DataFrame:
    """All unordered pairs ``(a, b)`` with equal ``equal`` columns and ``|ts_a - ts_b| <= tolerance``.

    ``orient="row"``: ``a`` is the row with the smaller ``row`` (input order);
    ``orient="time"``: ``a`` precedes ``b`` in ``(ts, row)`` order.
    Output: keys, equal columns, ``a_ts, a_row, b_ts, b_row`` and ``a_``/``b_`` copies of ``carry``.
    """
    tol = int(round(tolerance_minutes * 60_000_000))
    carry = list(carry or [])
    base = df.select(*keys, *equal, ts, row, *carry).withColumn("_t", epoch_micros(ts)).withColumn(
        "_tb", F.floor(F.col("_t") / F.lit(tol)))
    for c in equal:
        base = base.filter(F.col(c).isNotNull())
    left = base.select(*keys, *equal, "_tb", *[F.col(c).alias(f"a_{c}") for c in (ts, row, "_t", *carry)])
    right = base.select(*keys, *equal, F.explode(F.array(F.col("_tb") - 1, F.col("_tb"), F.col("_tb") + 1)).alias("_tb"),
                        *[F.col(c).alias(f"b_{c}") for c in (ts, row, "_t", *carry)])
    if orient == "row":
        first = F.col(f"a_{row}") < F.col(f"b_{row}")
    elif orient == "time":
        first = F.struct(F.col("a__t"), F.col(f"a_{row}")) < F.struct(F.col("b__t"), F.col(f"b_{row}"))
    else:
        raise ValueError("orient must be 'row' or 'time'")
    pairs = left.join(right, keys + equal + ["_tb"]).filter(
        first & (F.abs(F.col("a__t") - F.col("b__t")) <= F.lit(tol)))
    return pairs.select(*keys, *equal, F.col(f"a_{ts}").alias("a_ts"), F.col(f"a_{row}").alias("a_row"),
                        F.col(f"b_{ts}").alias("b_ts"), F.col(f"b_{row}").alias("b_row"),
                        *[F.col(f"{p}_{c}") for c in carry for p in ("a", "b")])
