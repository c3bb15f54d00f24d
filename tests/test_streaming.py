"""Streaming ingestion and month-to-date state equal their batch counterparts (ST1, ST2)."""

from __future__ import annotations

from datetime import datetime

from conftest import SF

from fleetlog.operators import aggregates as agg
from fleetlog.operators import rules
from fleetlog.sources import fixtures as fx
from fleetlog.streaming import ingest


def test_stream_ingest_equals_batch(spark):
    streamed = {r["row_num"] for r in ingest.stream_ingest_query(spark, SF).collect()}
    batch = {r["row_num"] for r in rules.validate_fuel(fx.fx_dirty(spark, SF), ["vehicle_id"]).good.collect()}
    assert streamed == batch and len(batch) == 1233


def test_stream_month_to_date_equals_batch(spark):
    streamed = {r["vehicle_id"]: (r["month_entries"], round(r["month_liters"], 6))
                for r in ingest.stream_month_to_date_query(spark, SF).collect()}
    from datetime import datetime
    batch = {r["vehicle_id"]: (r["month_entries"], round(r["month_liters"], 6))
             for r in agg.month_to_date(fx.fx_fuel(spark, SF), datetime(2024, 1, 15)).collect()}
    assert streamed == batch


FUEL = "vehicle_id long, event_ts timestamp_ntz, row_num long, amount_eur double, liters double"


def test_late_rows_in_any_order_count(spark, tmp_path):
    """One file a batch, months shuffled, a restart in between: nothing is late (ST2)."""
    src, days = tmp_path / "in", [(1, 10), (6, 10), (6, 11), (1, 20), (1, 21)]

    def arrive(some):
        for i, (month, day) in some:
            df = spark.createDataFrame([(1, datetime(2024, month, day), i, 20.0, 10.0)], FUEL)
            df.coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema(FUEL).option("maxFilesPerTrigger", 1).parquet(str(src))
        ingest.run_month_to_date(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return {r["month"].month: (r["month_liters"], r["month_entries"]) for r in ingest.latest_month_to_date(spark, str(tmp_path / "out")).collect()}

    arrive([*enumerate(days)][:3])
    assert run() == {1: (10.0, 1), 6: (20.0, 2)}
    arrive([*enumerate(days)][3:])
    assert run() == {1: (30.0, 3), 6: (20.0, 2)}


def test_entries_stream_keeps_rejected_rows_as_entered(spark, tmp_path):
    cols = ("vehicle_id long, row_num long, station_name string, city string, country string, liters string, "
            "amount_eur string, entry_date string, fuel_type string, is_full_tank string, notes string")
    rows = [(1, 1, "Nord", "Kiel", "de", "42,5", "70,129", "2024-03-15T08:30", "E10", "true", ""),
            (1, 2, "", "Kiel", "DE", "x1", "70", "2024-03-16", "E10", "true", "as written ")]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    ingest.ingest_entries(stream, str(tmp_path / "a"), str(tmp_path / "r"), str(tmp_path / "ck"), clean=True).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "a")).first()
    assert (good["liters"], good["amount_eur"], good["country"]) == (42.5, 70.13, "DE")
    bad = spark.read.parquet(str(tmp_path / "r")).first()
    assert bad["liters"] == "x1" and bad["notes"] == "as written " and set(bad["errors"]) == {"station_name", "liters"}


def test_units_hold_each_epoch_once_and_stay_few():
    for n in range(1, 1100):
        held = [e for t, last in ingest.units(n) for e in range(last - 16 ** t + 1, last + 1)]
        assert held == list(range(n)) and len(ingest.units(n)) <= 15 * 3


def test_merges_and_a_restart_in_the_middle_of_one(spark, tmp_path, monkeypatch):
    """Tiers of two: the files read stay few, and a batch that dies while it merges is repeated."""
    out, keys = str(tmp_path / "out"), ["vehicle_id"]

    def epoch(e):
        rows = [(1, datetime(2024, 1 + e % 3, 5), e, 2.0 * e, 1.0), (2, datetime(2023, 12, 31), e, 1.0, 1.0)]
        ingest.write_epoch(ingest.month_sums(spark.createDataFrame(rows, FUEL), keys), out, e, keys, fan=2)

    def now():
        return {(r.vehicle_id, r.month.month): (r.month_liters, r.month_eur, r.month_entries) for r in ingest.latest_month_to_date(spark, out, keys, fan=2).collect()}

    def want(n):
        found = {(2, 12): (float(n), float(n), n)}
        for m in range(3):
            of = [e for e in range(n) if e % 3 == m]
            if of:
                found[(1, m + 1)] = (float(len(of)), 2.0 * sum(of), len(of))
        return found

    for e in range(7):
        epoch(e)
        assert now() == want(e + 1)
    real = ingest._added_up

    def dies(sums, keys):
        if dies.left == 0:
            raise KeyboardInterrupt
        dies.left -= 1
        return real(sums, keys)
    dies.left = 1      # epoch 7 merges three tiers: the second merge dies
    monkeypatch.setattr(ingest, "_added_up", dies)
    try:
        epoch(7)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    assert now() == want(7)
    epoch(7)
    epoch(7)           # and a repeated batch changes nothing
    assert now() == want(8) and ingest.units(8, 2) == [(3, 7)]
