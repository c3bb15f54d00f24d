"""Periods, report sections, summaries and the analysis payload."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from conftest import fuel_df, odo_df

from fleetlog.functions.calendar import Period, month_bounds, normalize_boundary, parse_boundary, resolve_range
from fleetlog.operators import lookups as lk
from fleetlog.plans import report
from fleetlog.sources import store

FUEL = [("2024-03-15 10:00:00", 40, 72), ("2024-04-15 10:00:00", 45, 72), ("2024-04-20 10:00:00", 30, 60)]
ODO = [("2024-03-01 10:00:00", 45000), ("2024-05-01 10:00:00", 46000)]


def test_month_bounds_and_ranges():
    assert month_bounds(datetime(2024, 12, 5)) == (datetime(2024, 12, 1), datetime(2024, 12, 31, 23, 59, 59, 999999))
    as_of = datetime(2024, 3, 10, 15, 30)
    assert resolve_range("last_month", as_of).start == datetime(2024, 2, 1)
    assert resolve_range("last_12_months", as_of).start == datetime(2023, 3, 11)
    assert resolve_range("ytd", as_of).end == as_of
    c = resolve_range("custom", as_of, "2024-03-01", "2024-03-02")
    assert c.end == datetime(2024, 3, 2, 23, 59, 59) and c.label == "2024-03-01 → 2024-03-02"
    with pytest.raises(ValueError, match="unknown range"):
        resolve_range("decade", as_of)
    with pytest.raises(ValueError, match="requires start and end"):
        resolve_range("custom", as_of)


def test_boundaries():
    assert normalize_boundary(date(2024, 3, 15), None, False) == datetime(2024, 3, 15)
    assert normalize_boundary(date(2024, 3, 16), None, True) == datetime(2024, 3, 16, 23, 59, 59, 999999)
    assert parse_boundary("2024-03-15T10:00") == datetime(2024, 3, 15, 10, 0)
    assert parse_boundary("2024-03-15") == date(2024, 3, 15)


def test_report_period_single_and_keyed(spark):
    f, o = fuel_df(spark, FUEL), odo_df(spark, ODO)
    p = lk.report_period(f, o)
    assert p.start == datetime(2024, 3, 1, 10) and p.end == datetime(2024, 5, 1, 10)
    p = lk.report_period(f, o, date(2024, 3, 15), date(2024, 3, 16))
    assert p.end == datetime(2024, 3, 16, 23, 59, 59, 999999)
    with pytest.raises(ValueError, match="must not be after"):
        lk.report_period(f, o, date(2024, 4, 1), date(2024, 3, 1))
    with pytest.raises(ValueError, match="without any"):
        lk.report_period(f.limit(0), o.limit(0))
    keyed = lk.resolve_report_periods(f, o).first()
    assert keyed["start"] == datetime(2024, 3, 1, 10)


def test_report_cards(spark):
    f, o = fuel_df(spark, FUEL), odo_df(spark, ODO)
    period = Period(datetime(2024, 4, 1), datetime(2024, 4, 30, 23, 59, 59, 999999))
    cards = {(r["section"], r["metric"]): r for r in report.report_cards(f, o, period).collect()}
    assert cards[("fuel", "fuel_stops")]["value"] == 2
    assert cards[("fuel", "average_fuel_price")]["value"] == pytest.approx(132 / 75)
    assert cards[("distance", "observed_odometer_readings")]["value"] == 0
    est = cards[("distance", "estimated_overall_distance_driven")]
    assert est["tone"] == "estimated" and est["value"] == pytest.approx(1000 * 29.999999988 / 61, rel=1e-6)
    # one segment in the period (04-15 -> 04-20); 03-15 is outside so 04-15 has no predecessor
    assert cards[("estimated", "consumption_intervals")]["value"] == 1


def test_report_cards_empty_period(spark):
    f, o = fuel_df(spark, FUEL), odo_df(spark, ODO)
    period = Period(datetime(2025, 1, 1), datetime(2025, 1, 31))
    rows = report.report_cards(f, o, period).collect()
    fuel = [r for r in rows if r["section"] == "fuel"]
    assert len(fuel) == 1 and fuel[0]["value"] == 0 and fuel[0]["tone"] == "neutral"
    est = [r for r in rows if r["metric"] == "estimated_overall_distance_driven"][0]
    assert est["value"] is None and est["note"].startswith("start: after last record")


def test_build_and_write_report(spark, tmp_path):
    f, o = fuel_df(spark, FUEL), odo_df(spark, ODO)
    period = Period(datetime(2024, 3, 1), datetime(2024, 5, 31))
    sections = report.build_report(f, o, period)
    assert {"fuel_cards", "boundaries", "consumption", "country_overview", "odometer_readings"} <= set(sections)
    b = {r["boundary"]: r for r in sections["boundaries"].collect()}
    assert b["Start of report"]["quality"] == "insufficient"
    written = store.write_report(sections, str(tmp_path / "report"), period)
    assert spark.read.parquet(written["consumption"]).count() == 2


def test_summary_and_payload(spark):
    f, o = fuel_df(spark, FUEL), odo_df(spark, ODO)
    s = report.summary_all(f, o).first()
    assert s["entries"] == 3 and s["segments"] == 2 and s["total_km"] == 1000
    period = resolve_range("custom", datetime(2024, 5, 1), "2024-04-01", "2024-04-30")
    p = report.analysis_payload(f, o, period).first()
    payload = json.loads(p["payload"])
    assert payload["range"] == "custom" and payload["metrics"]["entries"] == 2
    assert [m["month"] for m in payload["charts"]["monthly_liters"]] == ["2024-04"]
    assert p["consumption_points"] == 1
    m = report.analysis_metrics(f.limit(0), o, period).first()
    assert m["avg_l_per_100km"] is None and m["entries"] == 0


def test_report_counts_the_pairs_of_a_duplicate_issue(spark):
    """Four equal purchases of one instant are six pairs, in the report as in the summary."""
    from fleetlog.operators import rules
    rows = [("2024-03-01 10:00", "70", "40", "E5", "true", "s", "c", "DE", "", i) for i in range(2, 6)]
    raw = spark.createDataFrame(rows, "datetime string, amount_eur string, liters string, fuel_type string, is_full_tank string, "
                                      "station_name string, city string, country string, notes string, row_num long")
    v = rules.validate_fuel(raw, [])
    period = Period(datetime(2024, 3, 1), datetime(2024, 3, 31, 23, 59, 59))
    odo = odo_df(spark, [("2024-03-01", 1)]).drop("vehicle_id")
    counts = report.build_report(v.good, odo, period, [], fuel_issues=v.issues)["issue_counts"]
    assert [tuple(r) for r in counts.collect()] == [("fuel", "warning", 6)]
    assert [r.issues for r in rules.issue_summary(v.issues).collect()] == [6]


def test_sections_share_one_asof_pass(spark):
    """Cards read stored results: no log and no window is left in their plan."""
    from fleetlog.plans import fixture_queries as q
    plan = q.report_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "Window" not in plan and "LogicalRDD" in plan


def test_payload_chunks_are_bounded_and_whole(spark):
    period = Period(datetime(2024, 1, 1), datetime(2024, 12, 31))
    fuel = fuel_df(spark, [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d} 08:00", 10.0, 15.0) for i in range(100)])
    odo = odo_df(spark, [("2024-01-01", 0), ("2024-12-01", 50_000)])
    chunks = report.payload_chunks(fuel, odo, period, size=30).orderBy("chunk").collect()
    assert [(c.chunk, len(c.points)) for c in chunks] == [(0, 30), (1, 30), (2, 30), (3, 9)]
    times = [p.datetime for c in chunks for p in c.points]
    assert times == sorted(times) and len(set(times)) == 99
