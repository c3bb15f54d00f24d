"""Skew-safe ordered operators equal their naive per-key window definitions.

One vehicle holds most rows (spread over many time buckets, with tied
timestamps); the bucketed operators must give exactly what a plain
``partitionBy(vehicle).orderBy(ts, row)`` window gives, while their plans
partition the large side by (vehicle, bucket) instead of vehicle alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlog.operators.sequence import previous_row, running_total
from fleetlog.operators.asof import odometer_at
from fleetlog.operators.distance import cumulative_distance, monthly_km_driven, total_distance, with_delta
from fleetlog.operators.rules import odometer_monotonicity
from fleetlog.operators.consumption import consumption_estimates
from fleetlog.schema import FUEL_SCHEMA, ODO_SCHEMA


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    rows = []
    n = 0
    for v, count in ((1, 3000), (2, 300), (3, 200)):        # vehicle 1 holds ~86% of rows
        t = base
        for _ in range(count):
            t += timedelta(minutes=rnd.choice([0, 7, 45, 300, 1440 * 3]))  # ties and multi-day gaps
            n += 1
            rows.append((v, t, float(rnd.randint(0, 10_000)), "", n))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, ODO_SCHEMA)


def test_previous_row_equals_lag(hot):
    got = previous_row(hot, ["vehicle_id"], {"km": F.col("odometer_km"), "n": F.col("row_num")}, "p", bucket="1 day")
    w = Window.partitionBy("vehicle_id").orderBy("event_ts", "row_num")
    want = hot.withColumn("lag_km", F.lag("odometer_km").over(w)).withColumn("lag_n", F.lag("row_num").over(w))
    a = {r["row_num"]: (r["p"]["km"] if r["p"] else None, r["p"]["n"] if r["p"] else None) for r in got.collect()}
    b = {r["row_num"]: (r["lag_km"], r["lag_n"]) for r in want.collect()}
    assert a == b


def test_running_total_equals_window_sum(hot):
    got = running_total(hot, ["vehicle_id"], F.col("odometer_km"), "run", bucket="6 hours")
    w = Window.partitionBy("vehicle_id").orderBy("event_ts", "row_num").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("run", F.sum("odometer_km").over(w))
    a = {r["row_num"]: r["run"] for r in got.collect()}
    b = {r["row_num"]: r["run"] for r in want.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_total_distance_equals_first_last(hot):
    w = Window.partitionBy("vehicle_id").orderBy("event_ts", "row_num")
    ranked = hot.withColumn("i", F.row_number().over(w)).withColumn("j", F.row_number().over(
        Window.partitionBy("vehicle_id").orderBy(F.col("event_ts").desc(), F.col("row_num").desc())))
    first = {r["vehicle_id"]: r["odometer_km"] for r in ranked.filter("i = 1").collect()}
    last = {r["vehicle_id"]: r["odometer_km"] for r in ranked.filter("j = 1").collect()}
    got = {r["vehicle_id"]: r["total_km"] for r in total_distance(hot).collect()}
    assert got == {v: last[v] - first[v] for v in first}


def test_consumption_plan_partitions_by_bucket(spark, hot, tmp_path):
    """The final plan over stored logs, with nothing broadcast: the logs' rows are shuffled by
    (key, bucket) alone, windows over them need no other exchange, and nothing sorts to aggregate."""
    fuel = hot.select("vehicle_id", "event_ts", F.col("odometer_km").alias("amount_eur"),
                      F.lit(40.0).alias("liters"), "row_num").filter(F.col("row_num") % 3 == 0)
    fuel.write.parquet(str(tmp_path / "fuel"))
    hot.write.parquet(str(tmp_path / "odo"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        df = consumption_estimates(spark.read.parquet(str(tmp_path / "fuel")), spark.read.parquet(str(tmp_path / "odo")))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "isFinalPlan=true" in plan
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)}
    # rows by (key, bucket), bucket summaries by key, refuels by their place for the regroup
    assert keys == {"_kid, _bucket", "_kid", "vehicle_id, _own, _pos, _cur_ts"}, keys
    assert "coalesce(vehicle_id" not in plan
    # only the bucket summaries, which take a whole row in the total order, sort for their aggregate
    sorting = re.findall(r"SortAggregate\(key=\[(.*?)\], functions=", plan)
    assert sorting and {re.sub(r"#\d+L?", "", k) for k in sorting} == {"_kid, _bucket"}, sorting
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_null_keys_are_a_key_of_their_own(spark):
    rows = [(None, datetime(2024, 1, d), float(d), "", d) for d in (1, 2, 5)] + [(1, datetime(2024, 1, 3), 7.0, "", 9)]
    odo = spark.createDataFrame(rows, ODO_SCHEMA)
    got = {r["row_num"]: r["p"]["km"] if r["p"] else None
           for r in previous_row(odo, ["vehicle_id"], {"km": F.col("odometer_km")}, "p").collect()}
    assert got == {1: None, 2: 1.0, 5: 2.0, 9: None}
    assert {r["row_num"]: r["cumulative_km"] for r in cumulative_distance(odo).collect()} == {1: 0.0, 2: 1.0, 5: 4.0, 9: 0.0}
    run = {r["row_num"]: r["s"] for r in running_total(odo, ["vehicle_id"], F.col("odometer_km"), "s").collect()}
    assert run == {1: 1.0, 2: 3.0, 5: 8.0, 9: 7.0}


# --- repeated (time, row): one total order ------------------------------------------------

def _tied_rows(seed=3):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    return [(v, base + timedelta(hours=12 * rnd.randrange(40)), float(rnd.randrange(6) * 50), rnd.choice(["", "a", "b"]),
             rnd.choice([None, 1, 2])) for v in (1, 1, 1, 2, None) for _ in range(60)]


def _orders(spark, schema=ODO_SCHEMA):
    rows = _tied_rows()
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        yield spark.createDataFrame(rows, schema).repartition(seed + 1)


def _same_everywhere(spark, run):
    results = [Counter(map(str, run(df).collect())) for df in _orders(spark)]
    assert results[0] == results[1] == results[2]
    return results[0]


@pytest.mark.parametrize("bucket", ["6 hours", "1 day", "100 days"])
def test_repeated_time_and_row_have_one_order(spark, bucket):
    keys = ["vehicle_id"]
    payload = {"km": F.col("odometer_km"), "notes": F.col("notes")}
    previous = [_same_everywhere(spark, lambda d, b=b: previous_row(d, keys, payload, "p", bucket=b).drop("_bucket")) for b in (bucket, "1000 days")]
    assert previous[0] == previous[1]     # carried fields come from one row, as in a single bucket
    _same_everywhere(spark, lambda d: running_total(d, keys, F.col("odometer_km"), "run", bucket=bucket))
    _same_everywhere(spark, lambda d: cumulative_distance(d, keys, bucket=bucket))
    _same_everywhere(spark, lambda d: total_distance(d, keys))
    _same_everywhere(spark, lambda d: monthly_km_driven(d, keys))
    _same_everywhere(spark, lambda d: with_delta(d, keys, bucket=bucket))
    _same_everywhere(spark, lambda d: odometer_monotonicity(d, keys, bucket=bucket))


def test_tied_readings_give_one_estimate(spark):
    """Readings of 100 and 200 at one (time, row): the last before is the greatest, the first after
    the smallest, across buckets and inside one."""
    t = datetime(2024, 1, 2, 12)
    rows = [(1, t, 200.0, "x", 1), (1, t, 100.0, "", 1), (1, t + timedelta(days=2), 300.0, "", 2), (1, t + timedelta(days=2), 500.0, "", 2)]
    probe = spark.createDataFrame([(1, t + timedelta(days=1), 9), (1, t, 8)], "vehicle_id long, event_ts timestamp_ntz, row_num long")
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        for bucket in ("1 hour", "100 days"):
            got = {r.row_num: r.odometer["value"] for r in odometer_at(probe, spark.createDataFrame(order, ODO_SCHEMA), bucket=bucket).collect()}
            assert got == {9: 250.0, 8: 100.0}


def test_consumption_of_tied_refuels_and_readings(spark):
    rnd = random.Random(5)
    base = datetime(2024, 1, 1)
    fuel = [(1, base + timedelta(hours=6 * rnd.randrange(30)), float(rnd.randrange(1, 4)), float(rnd.randrange(1, 4)), 1.0, "E5", "true", "s", "c", "DE", "", 1)
            for _ in range(40)]
    seen = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(fuel)
        odo = next(d for i, d in enumerate(_orders(spark)) if i == seed - 1)
        seen.append(Counter(map(str, consumption_estimates(spark.createDataFrame(fuel, FUEL_SCHEMA).repartition(seed), odo).collect())))
    assert seen[0] == seen[1] == seen[2] and seen[0]
