"""What all sections of one period share, computed once and stored.

Three passes over the logs feed every card, mean, boundary and series:

* ``cube``: the fuel log summed up by key, month, fuel type and country, as exact
  decimals that add up further; rows outside the period only tell that a key exists;
* ``readings``: count, first and last reading of the period for each key;
* ``answered``: one as-of pass over a tagged union of the refuels' probes and the
  period's two boundaries.

Each is written by ``checkpoint()`` into the shared folder, so the sections read
the stored results and no plan holds another section's work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.calendar import Period
from fleetlog.operators.aggregates import fill_months
from fleetlog.operators.asof import distance_of, regroup_sides
from fleetlog.operators.consumption import consumption_summary, estimates_of, refuel_probes
from fleetlog.operators.sequence import DEFAULT_BUCKET, asof_neighbours, first_and_last, key_id
from fleetlog.schema import KEY, TS
from fleetlog.session import checkpoint_dir

START_SIDE, END_SIDE = 2, 3      # refuels have the sides 0 and 1


def _total(c: Column, name: str) -> Column:
    return F.sum(c.cast("decimal(28,9)")).alias(name)


def _double(c: str) -> Column:
    return F.sum(c).cast("double")


@dataclass(frozen=True)
class PeriodBase:
    """Results of one period (``None``: the whole logs), each run and stored when first asked for."""

    fuel: DataFrame
    odo: DataFrame
    period: Period | None
    keys: list[str]
    method: str
    bucket: object

    @property
    def inside(self) -> Column:
        return F.coalesce(self.period.contains(TS), F.lit(False)) if self.period else F.lit(True)

    @cached_property
    def cube(self) -> DataFrame:
        k, inside = self.keys, F.col("_in")
        price = F.try_divide("amount_eur", "liters")
        parts = {"_m": F.trunc(F.col(TS).cast("date"), "month"), "fuel_type": F.col("fuel_type"), "country": F.col("country")}
        cube = self.fuel.withColumn("_in", self.inside).groupBy(*k, "_in", *[F.when(inside, c).alias(n) for n, c in parts.items()]).agg(
            F.count_if(inside).alias("n"), _total(F.col("liters"), "liters"), _total(F.col("amount_eur"), "eur"),
            _total(price, "price"), F.count(price).alias("priced"))
        # rows outside only tell that the key exists
        sums = [F.when(inside, F.col(c)).alias(c) for c in ("liters", "eur", "price", "priced")]
        return cube.select(*k, *parts, "n", *sums).checkpoint(eager=True)

    @cached_property
    def readings(self) -> DataFrame:
        first, last = first_and_last("odometer_km", when=self.inside)
        return self.odo.groupBy(*self.keys).agg(F.count_if(self.inside).alias("readings"), first.alias("_first"),
                                                last.alias("_last")).checkpoint(eager=True)

    @cached_property
    def answered(self) -> DataFrame:
        k = self.keys
        probes = refuel_probes(self.fuel.filter(self.inside) if self.period else self.fuel, k, self.bucket)
        if self.period:
            universe = self.cube.select(*k).unionByName(self.readings.select(*k)).distinct()
            ends = F.array(*[F.struct(F.lit(side).alias("_side"), F.lit(t).cast("timestamp_ntz").alias(TS))
                             for side, t in ((START_SIDE, self.period.start), (END_SIDE, self.period.end))])
            probes = probes.unionByName(universe.select(*k, F.inline(ends)), allowMissingColumns=True)
        probes = probes.checkpoint(eager=True)
        found = asof_neighbours(probes, self.odo, k, "odometer_km", bucket=self.bucket, probe_buckets=probes.select(*k, TS))
        return found.checkpoint(eager=True)

    @cached_property
    def totals(self) -> DataFrame:
        """One row for each key of either log: ``_kid``, keys, entries, total_liters, total_eur
        (null without entries), avg_price_per_liter, readings, total_km."""
        k = self.keys
        n = F.sum("n")
        fuel = self.cube.groupBy(*k).agg(n.alias("entries"), *[F.when(n > 0, _double(c)).alias(f"total_{c}") for c in ("liters", "eur")])
        both = fuel.unionByName(self.readings, allowMissingColumns=True).groupBy(*k).agg(
            *[F.max(c).alias(c) for c in ("entries", "total_liters", "total_eur", "readings", "_first", "_last")])
        km = F.when(F.col("readings") < 2, 0.0).otherwise(F.col("_last") - F.col("_first"))
        return both.select(key_id(k).alias("_kid"), *k, F.coalesce("entries", F.lit(0)).alias("entries"), "total_liters", "total_eur",
                           F.coalesce(F.try_divide("total_eur", "total_liters"), F.lit(0.0)).alias("avg_price_per_liter"),
                           F.coalesce("readings", F.lit(0)).alias("readings"), F.coalesce(km, F.lit(0.0)).alias("total_km"))

    @cached_property
    def estimates(self) -> DataFrame:
        """Consumption segments."""
        return estimates_of(self.answered.filter(F.col("_side") < START_SIDE), self.keys, self.method)

    @cached_property
    def summary(self) -> DataFrame:
        """Means over the segments (C4) by ``_kid``."""
        return consumption_summary(self.estimates, self.keys).withColumn("_kid", key_id(self.keys)).drop(*self.keys)

    @cached_property
    def bounds(self) -> DataFrame:
        """``_kid, start_odometer, end_odometer, distance`` at the period's bounds (I8, K4)."""
        sides = {START_SIDE: ("start_odometer", TS), END_SIDE: ("end_odometer", TS)}
        ends = self.answered.filter(F.col("_side") >= START_SIDE).withColumn("_kid", key_id(self.keys))
        both = regroup_sides(ends, ["_kid"], "_side", sides, self.method)
        s, e = (F.lit(t).cast("timestamp_ntz") for t in (self.period.start, self.period.end))
        return distance_of(both.withColumns({"_s": s, "_e": e}), "start_odometer", "end_odometer", "_s", "_e").drop("_s", "_e")

    @cached_property
    def months(self) -> DataFrame:
        """``keys, month``, liters, amount_eur, avg_price_per_liter, gaps filled."""
        k = self.keys
        by = self.cube.filter("n > 0").groupBy(*k, "_m").agg(
            _double("liters").alias("liters"), _double("eur").alias("amount_eur"),
            F.try_divide(_double("price"), F.sum("priced")).alias("avg_price_per_liter"))
        return fill_months(by, k, {"liters": F.lit(0.0), "amount_eur": F.lit(0.0), "avg_price_per_liter": None})

    def by(self, column: str) -> DataFrame:
        """``keys, column``, count, total_liters, total_eur, avg_price_per_liter."""
        return self.cube.filter("n > 0").groupBy(*self.keys, column).agg(
            F.sum("n").alias("count"), _double("liters").alias("total_liters"), _double("eur").alias("total_eur")).withColumn(
            "avg_price_per_liter", F.try_divide("total_eur", "total_liters"))


def period_base(fuel: DataFrame, odo: DataFrame, period: Period | None = None, keys: list[str] | None = None,
                method: str = "linear", bucket=DEFAULT_BUCKET) -> PeriodBase:
    """The shared results of one period; without a period there are no boundary probes."""
    checkpoint_dir(fuel.sparkSession)
    return PeriodBase(fuel, odo, period, [KEY] if keys is None else list(keys), method, bucket)
