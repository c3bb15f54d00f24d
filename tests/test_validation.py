"""Row and dataset rules."""

from __future__ import annotations

import pytest

from fleetlog.operators import rules
from fleetlog.schema import FUEL_RAW_COLUMNS, ODO_RAW_COLUMNS

BASE = {"datetime": "2024-03-15 08:30:00", "amount_eur": "75.50", "liters": "42.50", "fuel_type": "E10",
        "is_full_tank": "true", "station_name": "Aral", "city": "Munich", "country": "DE", "notes": ""}


def raw_fuel(spark, *overrides):
    rows = [tuple([{**BASE, **o}[c] for c in FUEL_RAW_COLUMNS]) + (i + 2,) for i, o in enumerate(overrides)]
    schema = ", ".join(f"{c} string" for c in FUEL_RAW_COLUMNS) + ", row_num long"
    return spark.createDataFrame(rows, schema)


def raw_odo(spark, *rows):
    data = [(t, km, "", i + 2) for i, (t, km) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in ODO_RAW_COLUMNS) + ", row_num long")


def issues(v):
    return sorted((r["severity"], r["rule"], r["row_num"]) for r in v.issues.collect())


def test_valid_row(spark):
    v = rules.validate_fuel(raw_fuel(spark, {}))
    assert v.good.count() == 1 and issues(v) == []
    g = v.good.first()
    assert g["price_per_liter_eur"] == pytest.approx(75.5 / 42.5) and g["is_full_tank"] == "true"


@pytest.mark.parametrize("country,expected", [("Germany", ("error", "country_format")),
                                              ("de", ("error", "country_format")),
                                              ("AT", None), ("ES", ("warning", "country_not_primary"))])
def test_country_rules(spark, country, expected):
    v = rules.validate_fuel(raw_fuel(spark, {"country": country}))
    got = [(s, r) for s, r, _ in issues(v)]
    assert got == ([expected] if expected else [])
    assert v.good.count() == (0 if expected and expected[0] == "error" else 1)


@pytest.mark.parametrize("amount,expected", [("200.00", "price_high"), ("20.00", "price_low")])
def test_price_warnings_keep_row(spark, amount, expected):
    v = rules.validate_fuel(raw_fuel(spark, {"amount_eur": amount}))
    assert [r for _, r, _ in issues(v)] == [expected] and v.good.count() == 1


@pytest.mark.parametrize("field,value,rule", [("liters", "0", "liters_range"), ("amount_eur", "-10", "amount_eur_range"),
                                              ("amount_eur", "abc", "amount_eur_not_numeric"),
                                              ("datetime", "not-a-date", "datetime_unparsable"),
                                              ("datetime", "2024-02-30", "datetime_unparsable"),
                                              ("fuel_type", "E15", "fuel_type_invalid"),
                                              ("station_name", "  ", "station_missing"),
                                              ("amount_eur", "nan", "amount_eur_not_numeric")])
def test_hard_errors(spark, field, value, rule):
    v = rules.validate_fuel(raw_fuel(spark, {field: value}))
    assert [r for _, r, _ in issues(v)] == [rule] and v.good.count() == 0


def test_python_style_numbers_and_dates(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"amount_eur": "1_000", "liters": " 5e2 "},
                                     {"datetime": "2024-03-15"}, {"datetime": "2024-03-15T08:30"}))
    assert v.good.count() == 3


@pytest.mark.parametrize("text,state", [("true", "true"), ("True", "true"), ("1", "true"), ("yes", "true"),
                                        ("YES", "true"), ("false", "false"), ("0", "false"), ("NO", "false"),
                                        ("", "unknown"), ("  ", "unknown"), ("NA", "unknown"), ("none", "unknown")])
def test_tank_states(spark, text, state):
    v = rules.validate_fuel(raw_fuel(spark, {"is_full_tank": text}))
    assert v.good.first()["is_full_tank"] == state


def test_tank_error_short_circuits_later_rules(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"is_full_tank": "maybe", "country": "Germany", "city": ""}))
    assert [r for _, r, _ in issues(v)] == ["full_tank_invalid"]


def test_city_warning_survives_on_rejected_row(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"city": "", "liters": "0"}))
    assert sorted(r for _, r, _ in issues(v)) == ["city_missing", "liters_range"]


def test_fuel_duplicates(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"datetime": "2024-03-15 08:30:00"}, {"datetime": "2024-03-15 08:40:00"},
                                     {"datetime": "2024-03-15 08:35:00", "liters": "40"},
                                     {"datetime": "2024-03-15 10:40:00"}))
    dups = [r for r in v.issues.collect() if r["rule"] == "potential_duplicate"]
    assert len(dups) == 1 and (dups[0]["pair_row_a"], dups[0]["pair_row_b"]) == (2, 3)
    assert dups[0]["row_num"] is None and v.good.count() == 4
    assert dups[0]["message"] == ("Potential duplicate: rows with 42.5L at 2024-03-15 08:30:00 and "
                                  "2024-03-15 08:40:00 (within 0:20:00)")


def test_duplicate_at_exact_tolerance_is_inclusive(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"datetime": "2024-03-15 08:30:00"}, {"datetime": "2024-03-15 08:50:00"}))
    assert [r for _, r, _ in issues(v)] == ["potential_duplicate"]


def test_odometer_rules(spark):
    v = rules.validate_odometer(raw_odo(spark, ("2024-03-15 08:30:00", "50000"), ("2024-03-16 08:30:00", "49000"),
                                        ("2024-03-16 08:40:00", "49000"), ("2024-03-17", "-100"),
                                        ("2024-03-18", "abc"), ("2024-03-19", "0")))
    got = issues(v)
    assert ("error", "odometer_km_range", 5) in got and ("error", "odometer_km_not_numeric", 6) in got
    assert ("warning", "monotonicity", None) in got and ("warning", "potential_duplicate", None) in got
    assert v.good.count() == 4
    mono = [r for r in v.issues.collect() if r["rule"] == "monotonicity"]
    assert mono[0]["message"].startswith("Odometer monotonicity violation: 49000.0 km at 2024-03-16 08:30:00")


def test_issue_summary_and_lines(spark):
    v = rules.validate_fuel(raw_fuel(spark, {"country": "ES"}, {"liters": "0"}))
    s = {(r["severity"], r["rule"]): r["issues"] for r in rules.issue_summary(v.issues).collect()}
    assert s == {("warning", "country_not_primary"): 1, ("error", "liters_range"): 1}
    lines = sorted(r["line"] for r in rules.issue_lines(v.issues).collect())
    assert lines[0].startswith("  [ERROR] row 3: liters must be positive")


def test_quality_summary(spark):
    f = rules.validate_fuel(raw_fuel(spark, {}, {"liters": "0"}))
    o = rules.validate_odometer(raw_odo(spark, ("2024-03-15 08:30:00", "50000")))
    s = {r["dataset"]: r for r in rules.quality_summary(f, o).collect()}
    assert s["fuel"]["valid_records"] == 1 and not s["fuel"]["is_valid"] and s["odometer"]["is_valid"]


def test_entry_profile(spark):
    rows = [("Aral", "Munich", " de ", "40", "70", "2024-03-15T08:30", "E10", "TRUE", ""),
            ("", "", "Germany", "0", "-1", "yesterday", "E15", "maybe", ""),
            ("Aral", "Munich", "DE", "40", "200", "2024-03-15", "E10", "unknown", "")]
    cols = "station_name string, city string, country string, liters string, amount_eur string, entry_date string, " \
           "fuel_type string, is_full_tank string, notes string"
    accepted, rejected = rules.validate_entries(spark.createDataFrame(rows, cols))
    acc = accepted.orderBy("amount_eur").collect()
    assert [a["country"] for a in acc] == ["DE", "DE"] and acc[1]["warnings"] == [
        "Derived price per liter (5.000 EUR/L) is suspiciously high."]
    errs = rejected.first()["errors"]
    assert set(errs) == {"station_name", "city", "country", "liters", "amount_eur", "entry_date", "fuel_type",
                         "is_full_tank"}
    assert errs["country"] == "Must be a 2-letter ISO country code."


def test_clean_decimal(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("42,555",), ("1,5,3",), ("12.004",)], "x string")
    got = [r[0] for r in df.select(rules.clean_decimal(F.col("x"))).collect()]
    assert got[0] == pytest.approx(42.56) and got[1] is None and got[2] == pytest.approx(12.0)


def test_each_parse_stands_once_in_a_plan(spark):
    """Accepted and rejected rows are two branches; each has the four patterns once, as have
    rows and issues of a log."""
    from fleetlog.plans import fixture_queries as q
    for query in (q.entry_validation, q.fuel_issues):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") <= 8 and plan.count("try_cast") + plan.count("try_to") <= 20, plan.count("RLIKE")


def test_quality_summary_reads_each_log_once(spark):
    from fleetlog.plans import fixture_queries as q
    plan = q.quality_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "RLIKE" not in plan
