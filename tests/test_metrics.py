"""Aggregates, odometer series and consumption."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import dt, fuel_df, odo_df

from fleetlog.functions.calendar import Period, normalize_boundary
from fleetlog.operators import aggregates as agg
from fleetlog.operators import distance as dist
from fleetlog.operators.asof import distance_between
from fleetlog.operators.consumption import consumption_estimates, consumption_flat, consumption_summary


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_totals_and_weighted_price(spark):
    f = fuel_df(spark, [("2024-03-01 10:00:00", 10, 18), ("2024-03-02 10:00:00", 20, 40)])
    r = one(agg.fuel_totals(f))
    assert r["total_liters"] == 30 and r["total_eur"] == 58 and r["entries"] == 2
    assert r["avg_price_per_liter"] == pytest.approx(58 / 30)


def test_totals_of_nothing_is_zero(spark):
    f = fuel_df(spark, [("2024-03-01 10:00:00", 10, 18)]).limit(0)
    r = one(agg.fuel_totals(f, keys=[]))
    assert (r["entries"], r["total_liters"], r["total_eur"], r["avg_price_per_liter"]) == (0, 0.0, 0.0, 0.0)


def test_monthly_gap_months(spark):
    f = fuel_df(spark, [("2024-01-10 10:00:00", 10, 20), ("2024-04-02 10:00:00", 20, 30)])
    liters = {r["month"].date(): r["liters"] for r in agg.monthly_liters(f).collect()}
    assert liters == {date(2024, 1, 31): 10.0, date(2024, 2, 29): 0.0, date(2024, 3, 31): 0.0, date(2024, 4, 30): 20.0}
    trend = {r["month"].date(): r["avg_price_per_liter"] for r in agg.fuel_price_trend(f).collect()}
    assert trend[date(2024, 2, 29)] is None and trend[date(2024, 1, 31)] == pytest.approx(2.0)


def test_city_blank_removed_and_overview_rank(spark):
    f = fuel_df(spark, [{"event_ts": "2024-01-01 10:00:00", "liters": 10, "amount_eur": 20, "city": " "},
                        {"event_ts": "2024-01-02 10:00:00", "liters": 30, "amount_eur": 50, "city": "Lyon"},
                        {"event_ts": "2024-01-03 10:00:00", "liters": 30, "amount_eur": 40, "city": "Nice"},
                        {"event_ts": "2024-01-04 10:00:00", "liters": 5, "amount_eur": 9, "city": "Nice"}])
    cities = {r["city"] for r in agg.avg_price_by_city(f).collect()}
    assert cities == {"Lyon", "Nice"}
    ranks = {r["city"]: r["rank"] for r in agg.location_overview(f, "city").collect()}
    assert ranks == {"Nice": 1, "Lyon": 2}


def test_fuel_type_share(spark):
    f = fuel_df(spark, [{"event_ts": "2024-01-01 10:00:00", "liters": 10, "amount_eur": 20, "fuel_type": "E5"},
                        {"event_ts": "2024-01-02 10:00:00", "liters": 30, "amount_eur": 60, "fuel_type": "E10"}])
    s = {r["fuel_type"]: r for r in agg.fuel_type_share(f).collect()}
    assert s["E5"]["liters_share_pct"] == pytest.approx(25.0) and s["E10"]["stops_share_pct"] == pytest.approx(50.0)


READINGS = [("2024-03-01 10:00:00", 45000), ("2024-03-20 10:00:00", 45300), ("2024-04-01 10:00:00", 46000),
            ("2024-04-10 10:00:00", 45900)]


def test_total_distance_is_last_minus_first(spark):
    r = one(dist.total_distance(odo_df(spark, READINGS)))
    assert r["total_km"] == 900.0 and r["readings"] == 4
    r = one(dist.total_distance(odo_df(spark, READINGS[:1])))
    assert r["total_km"] == 0.0


def test_monthly_km_driven_month_start_labels(spark):
    m = {r["month"].date(): r["km_driven"] for r in dist.monthly_km_driven(odo_df(spark, READINGS)).collect()}
    assert m == {date(2024, 3, 1): 300.0, date(2024, 4, 1): -100.0}


def test_cumulative_and_delta(spark):
    o = odo_df(spark, READINGS)
    cum = sorted(r["cumulative_km"] for r in dist.cumulative_distance(o).collect())
    assert cum == [-0.0, 300.0, 900.0, 1000.0] or cum == [0.0, 300.0, 900.0, 1000.0]
    period = Period(datetime(2024, 3, 15), datetime(2024, 4, 30))
    tl = {r["event_ts"]: r["km_since_last_entry"] for r in dist.distance_timeline(o, period).collect()}
    # the delta of the first in-period reading comes from a reading outside the period
    assert tl == {dt("2024-03-20 10:00:00"): 300.0, dt("2024-04-01 10:00:00"): 700.0, dt("2024-04-10 10:00:00"): -100.0}
    whole = Period(datetime(2024, 1, 1), datetime(2024, 12, 31))
    rows = dist.odometer_readings_in_period(o, whole).collect()
    assert sum(r["km_since_previous"] is None for r in rows) == 1


def test_consumption_one_segment(spark):
    f = fuel_df(spark, [("2024-03-15 10:00:00", 40, 72), ("2024-04-15 10:00:00", 45, 72)])
    o = odo_df(spark, [("2024-03-01 10:00:00", 45000), ("2024-05-01 10:00:00", 46000)])
    seg = one(consumption_estimates(f, o))
    assert seg["estimated_km"] == pytest.approx(508.196721, abs=1e-6)
    assert seg["liters_per_100km"]["value"] == pytest.approx(8.854839, abs=1e-6)
    assert seg["liters_per_100km"]["quality"] == "estimated"
    assert seg["liters"] == 45
    flat = one(consumption_flat(consumption_estimates(f, o)))
    assert flat["source_interval"] == "2024-03-15 10:00:00 -> 2024-04-15 10:00:00"
    assert len(consumption_flat(consumption_estimates(f, o)).columns) == 22 + 3


def test_consumption_drops_insufficient_but_keeps_predecessor(spark):
    # first refuel is before the first reading: its pair is dropped, but it still is the
    # predecessor of the second; the third pairs with the second
    f = fuel_df(spark, [("2024-02-20 10:00:00", 40, 72), ("2024-03-10 10:00:00", 40, 72),
                        ("2024-03-20 10:00:00", 40, 72)])
    o = odo_df(spark, [("2024-03-01 10:00:00", 45000), ("2024-04-01 10:00:00", 46000)])
    segs = consumption_estimates(f, o).collect()
    assert len(segs) == 1 and segs[0]["previous_fuel_datetime"] == dt("2024-03-10 10:00:00")


def test_consumption_zero_km_dropped_and_empty_summary(spark):
    f = fuel_df(spark, [("2024-03-01 10:00:00", 40, 72), ("2024-03-02 10:00:00", 40, 72)])
    o = odo_df(spark, [("2024-03-01 00:00:00", 45000), ("2024-03-03 00:00:00", 45000)])
    assert consumption_estimates(f, o).count() == 0
    assert consumption_summary(consumption_estimates(f, o)).count() == 0


def _bounds(spark, start, end, vehicle=1):
    return spark.createDataFrame([(vehicle, start, end)], "vehicle_id long, start timestamp_ntz, end timestamp_ntz")


THREE = [("2024-03-01 10:00:00", 45000), ("2024-04-01 10:00:00", 46000), ("2024-05-01 10:00:00", 47000)]


def test_distance_between_exact_and_estimated(spark):
    o = odo_df(spark, THREE)
    r = one(distance_between(_bounds(spark, dt("2024-03-01 10:00:00"), dt("2024-04-01 10:00:00")), o))
    assert r["distance"]["value"] == 1000.0 and r["distance"]["quality"] == "exact"
    r = one(distance_between(_bounds(spark, dt("2024-03-15 10:00:00"), dt("2024-04-15 10:00:00")), o))
    assert r["distance"]["value"] == pytest.approx(1015.053763, abs=1e-6)
    assert r["distance"]["quality"] == "estimated"


def test_distance_between_negative_and_insufficient(spark):
    o = odo_df(spark, [("2024-03-01 10:00:00", 46000), ("2024-04-01 10:00:00", 45000)])
    r = one(distance_between(_bounds(spark, dt("2024-03-01 10:00:00"), dt("2024-04-01 10:00:00")), o))
    assert r["distance"]["quality"] == "insufficient"
    assert r["distance"]["source_interval"] == "negative distance between 2024-03-01 10:00:00 and 2024-04-01 10:00:00"
    r = one(distance_between(_bounds(spark, dt("2024-02-01 10:00:00"), dt("2024-03-01 10:00:00")), o))
    assert r["distance"]["source_interval"].startswith("start: before first record (")
    # zero distance is valid
    r = one(distance_between(_bounds(spark, dt("2024-03-01 10:00:00"), dt("2024-03-01 10:00:00")), o))
    assert r["distance"]["quality"] == "exact" and r["distance"]["value"] == 0.0


def test_distance_between_rejects_reversed_bounds(spark):
    o = odo_df(spark, THREE)
    with pytest.raises(Exception, match="start_dt must be before"):
        distance_between(_bounds(spark, dt("2024-04-01 10:00:00"), dt("2024-03-01 10:00:00")), o).collect()


def test_report_golden_boundaries(spark):
    o = odo_df(spark, [("2024-03-14 20:00:00", 45230), ("2024-03-22 18:00:00", 45810),
                       ("2024-04-18 12:00:00", 47350), ("2024-05-01 08:00:00", 48100)])
    start = normalize_boundary(date(2024, 3, 15), None, False)
    end = normalize_boundary(date(2024, 4, 30), None, True)
    r = one(distance_between(_bounds(spark, start, end), o))
    assert r["start_odometer"]["value"] == pytest.approx(45242.210526, abs=1e-6)
    assert r["end_odometer"]["value"] == pytest.approx(48080.519481, abs=1e-6)
    assert r["distance"]["value"] == pytest.approx(2838.308954, abs=1e-6)


def test_two_vehicles_are_independent(spark):
    o1 = [(1, "2024-03-01 10:00:00", 100), (1, "2024-03-03 10:00:00", 300)]
    o2 = [(2, "2024-03-01 10:00:00", 5000), (2, "2024-03-03 10:00:00", 5100)]
    alone = one(dist.total_distance(odo_df(spark, o1)))["total_km"]
    both = {r["vehicle_id"]: r["total_km"] for r in dist.total_distance(odo_df(spark, o1 + o2)).collect()}
    assert both == {1: alone, 2: 100.0}


def test_overview_without_keys_ranks_by_ranges(spark):
    """Equal ranks as one window would give, and no exchange into a single partition."""
    rows = [(i % 7, f"city{i % 211:03d}", float(i % 13 + 1), float(i % 5 + 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "vehicle_id long, city string, liters double, amount_eur double")
    got = agg.location_overview(df, "city", [])
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    found = sorted((r["rank"], r.city, r.liters, r.stops) for r in got.collect())
    by = {}
    for _, city, liters, _ in rows:
        by.setdefault(city, []).append(liters)
    want = sorted(by, key=lambda c: (-sum(by[c]), -len(by[c]), c))
    assert [(r, c) for r, c, _, _ in found] == [(i + 1, c) for i, c in enumerate(want)]
    assert agg.location_overview(df.limit(0), "city", []).count() == 0
