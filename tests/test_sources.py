"""CSV sources, row numbering, store writers (S1-S12) with the sample-log goldens."""

from __future__ import annotations

import csv
import random
from collections import defaultdict
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from samples import FUEL_CSV, ODO_CSV

from fleetlog.operators import aggregates as agg
from fleetlog.operators import distance as dist
from fleetlog.operators.consumption import consumption_estimates, consumption_summary
from fleetlog.plans import fixture_queries
from fleetlog.schema import FUEL_RAW_COLUMNS, FUEL_SCHEMA, ODO_SCHEMA
from fleetlog.sources import csv as csvsrc
from fleetlog.sources import store


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "fuel_log.csv").write_text(FUEL_CSV)
    (d / "odometer_log.csv").write_text(ODO_CSV)
    fuel = csvsrc.load_fuel_csv(spark, str(d / "fuel_log.csv"), vehicle_id=1)
    odo = csvsrc.load_odometer_csv(spark, str(d / "odometer_log.csv"), vehicle_id=1)
    return fuel, odo, d


def test_sample_logs_are_clean(logs):
    fuel, odo, _ = logs
    assert fuel.issues.count() == 0 and odo.issues.count() == 0
    assert sorted(r["row_num"] for r in fuel.good.collect()) == list(range(2, 8))
    states = sorted(r["is_full_tank"] for r in fuel.good.collect())
    assert states == ["false", "false", "true", "true", "true", "unknown"]


def test_sample_totals(logs):
    fuel, odo, _ = logs
    t = agg.fuel_totals(fuel.good).first()
    assert (t["entries"], t["total_liters"], t["total_eur"]) == (6, 192.0, 358.5)
    assert t["avg_price_per_liter"] == pytest.approx(1.8671875)
    assert dist.total_distance(odo.good).first()["total_km"] == 3890


def test_sample_breakdowns(logs):
    fuel, odo, _ = logs
    types = {r["fuel_type"]: (r["count"], r["total_liters"], r["total_eur"]) for r in agg.fuel_type_summary(fuel.good).collect()}
    assert types == {"E10": (4, 125.0, pytest.approx(229.6)), "E5": (2, 67.0, pytest.approx(128.9))}
    c = {r["country"]: r["avg_price_per_liter"] for r in agg.avg_price_by_country(fuel.good).collect()}
    assert c == {"DE": pytest.approx(173.4 / 92), "AT": pytest.approx(1.8), "HR": pytest.approx(1.84), "IT": pytest.approx(1.9)}
    m = {r["month"].date(): r["liters"] for r in agg.monthly_liters(fuel.good).collect()}
    assert m == {date(2023, 1, 31): 62.0, date(2023, 2, 28): 65.0, date(2023, 3, 31): 35.0, date(2023, 4, 30): 30.0}
    km = {r["month"].date(): r["km_driven"] for r in dist.monthly_km_driven(odo.good).collect()}
    assert km == {date(2023, 1, 1): 1120, date(2023, 2, 1): 0, date(2023, 3, 1): 840, date(2023, 4, 1): 0}


def test_sample_consumption(logs):
    fuel, odo, _ = logs
    seg = sorted(consumption_estimates(fuel.good, odo.good).collect(), key=lambda r: r["fuel_datetime"])
    assert len(seg) == 5 and all(s["liters_per_100km"]["quality"] == "estimated" for s in seg)
    assert seg[0]["estimated_km"] == pytest.approx(578.75)
    assert seg[0]["liters_per_100km"]["value"] == pytest.approx(5.529157667)
    assert seg[-1]["cost_per_100km"]["value"] == pytest.approx(5.832030695)
    s = consumption_summary(consumption_estimates(fuel.good, odo.good)).first()
    assert s["avg_l_per_100km"] == pytest.approx(4.931204274)
    assert s["avg_cost_per_100km"] == pytest.approx(9.264323202)
    assert s["avg_cost_per_km"] == pytest.approx(0.092643232)


def test_missing_file_and_columns(spark, tmp_path):
    v = csvsrc.load_fuel_csv(spark, str(tmp_path / "nope.csv"))
    assert v.good.count() == 0 and v.issues.first()["message"].startswith("File not found")
    (tmp_path / "bad.csv").write_text("datetime,odometer\n2024-01-01,5\n")
    v = csvsrc.load_odometer_csv(spark, str(tmp_path / "bad.csv"))
    assert v.issues.first()["message"] == "Missing required columns: ['notes', 'odometer_km']"


def test_quoted_newline_bom_short_rows_and_row_numbers(spark, tmp_path):
    text = ("﻿datetime,odometer_km,notes\n"
            "2024-01-01 10:00:00,100,\"two\nlines\"\n"
            "\n"
            "2024-01-02 10:00:00,200\n"
            "2024-01-03 10:00:00,-5,\"say \"\"hi\"\"\"\n")
    (tmp_path / "o.csv").write_text(text)
    v = csvsrc.load_odometer_csv(spark, str(tmp_path / "o.csv"), multiline=True)
    good = {r["row_num"]: r for r in v.good.collect()}
    assert set(good) == {2, 3} and good[2]["notes"] == "two\nlines" and good[3]["notes"] == ""
    bad = v.issues.first()
    assert bad["row_num"] == 4 and bad["rule"] == "odometer_km_range"


def test_folder_with_differing_headers_fails(spark, tmp_path):
    """Spark binds the files of a folder by position; a file with another header must not be read so."""
    (tmp_path / "a.csv").write_text("datetime,odometer_km,notes\n2024-01-01 10:00:00,100,first\n")
    (tmp_path / "b.csv").write_text("datetime,notes,odometer_km\n2024-01-02 10:00:00,second,200\n")
    with pytest.raises(Exception, match="header"):
        csvsrc.load_odometer_csv(spark, str(tmp_path)).good.collect()


def test_two_files_with_equal_row_numbers_pair(spark, tmp_path):
    """Row numbers start anew in each file; duplicates across files are still found."""
    head = "datetime,amount_eur,liters,fuel_type,is_full_tank,station_name,city,country,notes\n"
    for name, minute in (("a", "00"), ("b", "10")):
        (tmp_path / f"{name}.csv").write_text(head + f"2024-01-01 10:{minute}:00,70,40,E10,true,Nord,Kiel,DE,\n")
    issues = csvsrc.load_fuel_csv(spark, str(tmp_path)).issues.collect()
    assert [(i["rule"], i["pairs"], i["pair_row_a"], i["pair_row_b"]) for i in issues] == [("potential_duplicate", 1, 2, 2)]
    assert issues[0]["message"] == ("Potential duplicate: rows with 40.0L at 2024-01-01 10:00:00 and "
                                    "2024-01-01 10:10:00 (within 0:20:00)")


def test_row_numbers_on_split_files(spark, tmp_path):
    lines = ["datetime,odometer_km,notes"] + [f"2024-01-01 10:00:00,{i},note-{i:06d}" for i in range(20000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows, _ = csvsrc.read_raw_csv(spark, str(tmp_path / "big.csv"), ("datetime", "odometer_km", "notes"),
                                      "odometer", multiline=False)
        got = rows.select("row_num", "odometer_km").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 20000 and all(r["row_num"] == int(r["odometer_km"]) + 2 for r in got)


def test_store_backfill_is_idempotent(spark, logs, tmp_path):
    fuel, odo, _ = logs
    fp, op = str(tmp_path / "fuel"), str(tmp_path / "odo")
    assert store.import_if_empty(spark, fuel.good, odo.good, fp, op) == (6, 7)
    assert store.import_if_empty(spark, fuel.good, odo.good, fp, op) == (0, 0)
    back = store.read_log(spark, fp, vehicle=1)
    assert back.count() == 6 and "event_month" not in back.columns


def test_table_row_conversion(spark):
    df = spark.createDataFrame([(1, None, "weird", 10.0, 20.0)],
                               "vehicle_id long, notes string, is_full_tank string, liters double, amount_eur double")
    r = csvsrc.table_rows_to_fuel(df).first()
    assert r["notes"] == "" and r["is_full_tank"] == "unknown" and r["price_per_liter_eur"] == 2.0


def test_single_log_without_keys(spark, logs):
    """keys=[]: the whole input is one log (the original tool's case)."""
    fuel, odo, d = logs
    f = csvsrc.load_fuel_csv(spark, str(d / "fuel_log.csv"))
    o = csvsrc.load_odometer_csv(spark, str(d / "odometer_log.csv"))
    assert "vehicle_id" not in f.good.columns
    seg = sorted(consumption_estimates(f.good, o.good, keys=[]).collect(), key=lambda r: r["fuel_datetime"])
    keyed = sorted(consumption_estimates(fuel.good, odo.good).collect(), key=lambda r: r["fuel_datetime"])
    assert [round(s["estimated_km"], 6) for s in seg] == [round(s["estimated_km"], 6) for s in keyed]
    s = consumption_summary(consumption_estimates(f.good, o.good, keys=[]), keys=[]).first()
    assert s["avg_l_per_100km"] == pytest.approx(4.931204274)
    assert dist.total_distance(o.good, keys=[]).first()["total_km"] == 3890


def test_append_entries_writes_accepted_and_returns_rejected(spark, tmp_path):
    cols = ("vehicle_id long, row_num long, station_name string, city string, country string, liters string, "
            "amount_eur string, entry_date string, fuel_type string, is_full_tank string, notes string")
    rows = [(1, 1, "Aral", "Munich", "de", "40", "70", "2024-03-15T08:30", "E10", "true", " note "),
            (1, 2, "", "Munich", "DE", "40", "70", "2024-03-16T08:30", "E10", "true", ""),
            (2, 3, "OMV", "Graz", "AT", "30", "51", "2024-03-17", "E5", "unknown", "")]
    rejected = store.append_entries(spark, spark.createDataFrame(rows, cols), str(tmp_path / "fuel"))
    bad = rejected.collect()
    assert [r["row_num"] for r in bad] == [2] and bad[0]["errors"] == {"station_name": "Required."}
    assert bad[0]["entry_date"] == "2024-03-16T08:30"  # rejected rows come back as entered
    stored = store.read_log(spark, str(tmp_path / "fuel"))
    got = {r["row_num"]: r for r in stored.collect()}
    assert set(got) == {1, 3} and got[1]["country"] == "DE" and got[1]["notes"] == "note"
    assert got[3]["price_per_liter_eur"] == pytest.approx(1.7)


# --- quoted newlines and record identity ------------------------------------------------

HEADER = "datetime,odometer_km,notes\n"


def test_quoted_newlines_keep_rows_and_numbers(spark, tmp_path):
    (tmp_path / "log.csv").write_text(HEADER + '2024-01-01,100,"line one\nline two"\n2024-01-02,200,"say ""hi"""\n\n2024-01-03,bad,"a\n\n""b"\n'
                                      '2024-01-04,400,\n')
    v = csvsrc.load_odometer_csv(spark, str(tmp_path / "log.csv"))
    assert [(r.row_num, r.odometer_km, r.notes) for r in v.good.orderBy("row_num").collect()] == [
        (2, 100.0, "line one\nline two"), (3, 200.0, 'say "hi"'), (5, 400.0, "")]
    assert [(r.row_num, r.rule) for r in v.issues.collect()] == [(4, "odometer_km_not_numeric")]
    assert v.issues.first().source_file.endswith("/log.csv")


def test_only_files_with_open_lines_are_read_whole(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "b 1.csv").write_text(HEADER + "".join(f"2024-01-{d:02d},{d},\n" for d in range(1, 29)))
    (folder / "a.csv").write_text(HEADER + '2024-02-01,500,"x\ny"\n2024-02-01,500,\n')
    (folder / "c.csv").write_text(HEADER + '2024-02-01,500,"x\ny"\n2024-02-01,500,\n')
    assert [f.rsplit("/", 1)[1] for f in csvsrc.open_line_files(spark, str(folder))] == ["a.csv", "c.csv"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows, _ = csvsrc.read_raw_csv(spark, str(folder), ("datetime", "odometer_km", "notes"), "odometer")
        found = rows.collect()
        by_lines = csvsrc._reader(spark, False).csv(str(folder)).filter(~F.col("_metadata.file_path").isin(*csvsrc.open_line_files(spark, str(folder))))
        assert by_lines.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.row_num for r in found}) == len(found) == 32
    numbers = defaultdict(list)
    for r in found:
        numbers[r.source_file.rsplit("/", 1)[1]].append((r.row_num >> csvsrc.FILE_SHIFT, r.row_num & (1 << csvsrc.FILE_SHIFT) - 1, r.odometer_km))
    assert sorted(numbers["b%201.csv"]) == [(1, d + 1, str(d)) for d in range(1, 29)]
    assert sorted(numbers["a.csv"]) == [(0, 2, "500"), (0, 3, "500")] and sorted(numbers["c.csv"]) == [(2, 2, "500"), (2, 3, "500")]


def test_equal_rows_of_two_files_are_two_rows_and_issues_name_them(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(HEADER + "2024-01-01 10:00,100,\n2024-01-01 12:00,90,\nx,1,\n")
    v = csvsrc.load_odometer_csv(spark, str(tmp_path))
    assert v.good.count() == 4 and v.good.select("row_num").distinct().count() == 4
    where = {(r.rule, (r.source_file or "").rsplit("/", 1)[-1], r.row_num, (r.pair_file_a or "").rsplit("/", 1)[-1], r.pair_row_a, r.pair_row_b, r.pairs)
             for r in v.issues.collect()}
    assert where == {("datetime_unparsable", "a.csv", 4, "", None, None, 1), ("datetime_unparsable", "b.csv", 4, "", None, None, 1),
                     ("monotonicity", "a.csv", None, "b.csv", 2, 3, 1),
                     ("potential_duplicate", "b.csv", None, "a.csv", 2, 2, 1), ("potential_duplicate", "b.csv", None, "a.csv", 3, 3, 1)}
    named = csvsrc.with_source(v.good, csvsrc.source_files(spark, str(tmp_path)))
    assert sorted((r.source_file.rsplit("/", 1)[1], r.record) for r in named.collect()) == [("a.csv", 2), ("a.csv", 3), ("b.csv", 2), ("b.csv", 3)]


def test_every_file_with_open_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '2024-01-01,1,"p\nq"\n')
    (tmp_path / "b.csv").write_text(HEADER + '2024-01-01,2,"p\r\nq"\n2024-01-02,3,5"\n')
    rows, _ = csvsrc.read_raw_csv(spark, str(tmp_path), ("datetime", "odometer_km", "notes"), "odometer")
    assert sorted((r.odometer_km, r.notes) for r in rows.collect())[0] == ("1", "p\nq")
    assert rows.count() == 3


def test_rows_of_a_file_are_numbered_where_they_are_read(spark, tmp_path):
    """No window over a file's rows and no join that brings them together."""
    (tmp_path / "a.csv").write_text(HEADER + '2024-01-01,1,"p\nq"\n2024-01-02,2,\n')
    (tmp_path / "b.csv").write_text(HEADER + "2024-01-01,3,\n")
    rows, _ = csvsrc.read_raw_csv(spark, str(tmp_path), ("datetime", "odometer_km", "notes"), "odometer")
    plan = csvsrc.with_source(rows.drop("source_file"), csvsrc.source_files(spark, str(tmp_path)))._jdf.queryExecution().sparkPlan().toString()
    assert "row_number" not in plan and "SortMergeJoin" not in plan
    low = (1 << csvsrc.FILE_SHIFT) - 1
    assert sorted((r.row_num >> csvsrc.FILE_SHIFT, r.row_num & low, r.odometer_km) for r in rows.collect()) == [(0, 2, "1"), (0, 3, "2"), (1, 2, "3")]


def test_files_of_fixture_rows_are_in_order_over_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixture_queries, "FILE_CHUNK", 7)
    orders = [(k, k, datetime(2024, 1, 1), 3000.0 * k, "F") for k in random.Random(3).sample(range(1, 61), 60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet"))
    path = fixture_queries._three_files(spark, str(tmp_path), FUEL_RAW_COLUMNS, "ordered").removeprefix("file:")
    for part in range(3):
        (file,) = Path(path, f"part={part}").glob("part-*")
        with file.open(newline="") as lines:
            head, *found = csv.reader(lines)
        assert set(head) == set(FUEL_RAW_COLUMNS)
        assert [float(r[head.index("amount_eur")]) for r in found] == [k for k in range(1, 61) if (k + 2) % 3 == part]
        assert {r[head.index("notes")] for r in found} <= {"", 'say "one"\nand two,'}


# --- committed batches --------------------------------------------------------------------

def _fuel_rows(spark, rows):
    return spark.createDataFrame([(v, datetime(2024, m, 1 + n % 28), 10.0 + n, 5.0, 2.0, "E5", "true", "s", "c", "DE", "", n) for v, m, n in rows], FUEL_SCHEMA)


def test_killed_write_and_rerun_store_every_row_once(spark, tmp_path, monkeypatch):
    path, odo_path = str(tmp_path / "fuel"), str(tmp_path / "odo")
    fuel = _fuel_rows(spark, [(v, 1 + n % 3, n) for v in (1, 2, 3) for n in range(20)])
    odo = spark.createDataFrame([], ODO_SCHEMA)

    def killed(*_):      # after the data, before the commit record
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        store.import_if_empty(spark, fuel, odo, path, odo_path)
    assert any((tmp_path / "fuel" / "data").rglob("*.parquet")) and store.commits(spark, path) == {}
    monkeypatch.undo()
    assert store.import_if_empty(spark, fuel, odo, path, odo_path) == (60, 0)
    assert store.import_if_empty(spark, fuel, odo, path, odo_path) == (0, 0)
    more = _fuel_rows(spark, [(3, 1, 99), (4, 1, 100)])
    assert store.import_if_empty(spark, more, odo, path, odo_path) == (1, 0)      # only the new vehicle
    back = store.read_log(spark, path)
    assert back.count() == 61 and back.distinct().count() == 61


def test_the_same_batch_appends_once_and_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "fuel")
    parts = [_fuel_rows(spark, [(v, 1 + n % 2, n) for n in range(i, 30, 3)]) for i in range(3) for v in (i,)]
    assert [store.write_log(p, path) for p in parts] == [10, 10, 10]
    assert store.write_log(parts[1].repartition(4), path) == 0
    before = sorted(store.read_log(spark, path).collect())
    assert store.compact_log(spark, path) == 30 and len(store.commits(spark, path)) == 1 and store.compact_log(spark, path) == 0
    assert sorted(store.read_log(spark, path).collect()) == before
    assert store.write_log(parts[1], path) == 0                                   # replaced, not forgotten
    assert store.write_log(parts[0].limit(2), path, "overwrite") == 2 and store.read_log(spark, path).count() == 2


def test_a_vehicle_reads_the_files_of_its_bucket(spark, tmp_path):
    path = str(tmp_path / "fuel")
    store.write_log(_fuel_rows(spark, [(v, 1 + n % 2, n) for v in range(40) for n in range(4)]), path)
    whole, one = store.read_log(spark, path), store.read_log(spark, path, vehicle=7)
    assert sorted(r.row_num for r in one.collect()) == [0, 1, 2, 3] and {r.vehicle_id for r in one.collect()} == {7}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [key_bucket" in plan

    def opened(df):      # files that the scan lists, from its metrics
        scans = df._jdf.queryExecution().executedPlan().collectLeaves()
        df.collect()
        return sum(scans.apply(i).metrics().apply("numFiles").value() for i in range(scans.size()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, all_ = opened(store.read_log(spark, path, vehicle=7)), opened(store.read_log(spark, path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < few <= 4 < all_
    assert whole.count() == 160
