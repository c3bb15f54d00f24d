"""As-of alignment and linear interpolation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import dt, odo_df, probes_df

from fleetlog.operators.asof import get_interpolation_strategy, odometer_at

THREE = [("2024-03-01 10:00:00", 45000), ("2024-04-01 10:00:00", 46000), ("2024-05-01 10:00:00", 47500)]


def estimate(spark, readings, times, **kw):
    out = odometer_at(probes_df(spark, times), odo_df(spark, readings), **kw)
    return {r["row_num"]: r["odometer"] for r in out.collect()}


def test_exact_matches(spark):
    e = estimate(spark, THREE, [t for t, _ in THREE])
    for i, (t, km) in enumerate(THREE):
        assert e[i]["value"] == km
        assert e[i]["quality"] == "exact"
        assert e[i]["source_interval"] == f"exact match at {t}"
        assert e[i]["method"] == "linear"


def test_between_readings(spark):
    e = estimate(spark, THREE, ["2024-03-16 22:00:00", "2024-04-16 10:00:00"])
    assert e[0]["value"] == pytest.approx(45500.0)
    assert e[1]["value"] == pytest.approx(46750.0)
    assert e[0]["quality"] == e[1]["quality"] == "estimated"
    assert e[0]["source_interval"] == "2024-03-01 10:00:00 -> 2024-04-01 10:00:00"


def test_outside_range_is_insufficient(spark):
    e = estimate(spark, THREE, ["2024-02-01 00:00:00", "2024-06-01 00:00:00"])
    assert e[0]["quality"] == e[1]["quality"] == "insufficient"
    assert e[0]["value"] == e[1]["value"] == 0.0
    assert e[0]["source_interval"] == "before first record (2024-03-01 10:00:00)"
    assert e[1]["source_interval"] == "after last record (2024-05-01 10:00:00)"


def test_no_readings_for_vehicle(spark):
    out = odometer_at(probes_df(spark, ["2024-03-15 00:00:00"], vehicle=9), odo_df(spark, THREE)).collect()
    assert out[0]["odometer"]["quality"] == "insufficient"
    assert out[0]["odometer"]["source_interval"] is None


def test_single_record(spark):
    e = estimate(spark, [THREE[0]], ["2024-03-01 10:00:00", "2024-03-05 00:00:00"])
    assert e[0]["quality"] == "exact"
    assert e[1]["quality"] == "insufficient"


def test_unsorted_input(spark):
    e = estimate(spark, list(reversed(THREE)), ["2024-03-16 22:00:00"])
    assert e[0]["value"] == pytest.approx(45500.0)


def test_unknown_method():
    with pytest.raises(ValueError, match="Unknown interpolation method"):
        get_interpolation_strategy("cubic")


def test_ties_before_last_after_first_exact_first(spark):
    readings = [("2024-03-01 10:00:00", 100), ("2024-03-01 10:00:00", 200),
                ("2024-03-02 10:00:00", 300), ("2024-03-02 10:00:00", 400)]
    e = estimate(spark, readings, ["2024-03-01 22:00:00", "2024-03-01 10:00:00", "2024-03-02 10:00:00"])
    # before = last tied reading (200), after = first tied reading (300)
    assert e[0]["value"] == pytest.approx(250.0)
    assert e[1]["value"] == 100 and e[2]["value"] == 300


def test_microsecond_provenance_text(spark):
    e = estimate(spark, [("2024-03-01 10:00:00.250000", 1), ("2024-03-02 10:00:00", 2)], ["2024-03-01 12:00:00"])
    assert e[0]["source_interval"] == "2024-03-01 10:00:00.250000 -> 2024-03-02 10:00:00"


def test_neighbours_across_many_empty_buckets(spark):
    # readings a year apart, probes in between: the carry must bridge hundreds of empty day-buckets
    readings = [("2023-01-01 00:00:00", 0), ("2024-01-01 00:00:00", 36500)]
    e = estimate(spark, readings, ["2023-07-02 12:00:00"], bucket="1 hour")
    assert e[0]["value"] == pytest.approx(36500 * (182.5 / 365))


def _brute(readings, t):
    exact = [r for r in readings if r[0] == t]
    if exact:
        return exact[0][1], "exact"
    before = [r for r in readings if r[0] < t]
    after = [r for r in readings if r[0] > t]
    if not before or not after:
        return 0.0, "insufficient"
    b, a = before[-1], after[0]
    frac = (t - b[0]).total_seconds() / (a[0] - b[0]).total_seconds()
    return b[1] + frac * (a[1] - b[1]), "estimated"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force_two_vehicles(spark, seed):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows, probes, truth = [], [], {}
    for v in (1, 2):
        times = sorted(base + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20, 30)) for _ in range(40))
        readings = [(t, float(i * 10 + rnd.random())) for i, t in enumerate(times)]
        rows += [(v, t.isoformat(sep=" "), km) for t, km in readings]
        for j in range(30):
            t = base + timedelta(minutes=rnd.randrange(-600, 60 * 24 * 21, 30))
            probes.append((v, t, v * 1000 + j))
            truth[v * 1000 + j] = _brute(readings, t)
    p = spark.createDataFrame(probes, "vehicle_id long, event_ts timestamp_ntz, row_num long")
    out = odometer_at(p, odo_df(spark, rows), bucket="6 hours").collect()
    assert len(out) == len(probes)
    for r in out:
        value, quality = truth[r["row_num"]]
        assert r["odometer"]["quality"] == quality
        assert r["odometer"]["value"] == pytest.approx(value)
