"""Shared Spark session and small frame builders for the tests."""

from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlog.schema import FUEL_SCHEMA, ODO_SCHEMA  # noqa: E402
from fleetlog.session import checkpoint_dir, get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    checkpoint_dir(s)
    yield s


def dt(text: str) -> datetime:
    return datetime.fromisoformat(text)


def odo_df(spark, readings, vehicle=1):
    """readings: list of (datetime text, km) or (vehicle, datetime text, km)."""
    rows = []
    for i, r in enumerate(readings):
        v, t, km = (vehicle, *r) if len(r) == 2 else r
        rows.append((v, dt(t), float(km), "", i + 2))
    return spark.createDataFrame(rows, ODO_SCHEMA)


def fuel_df(spark, events, vehicle=1):
    """events: list of (datetime text, liters, amount) or dicts with overrides."""
    rows = []
    for i, e in enumerate(events):
        if isinstance(e, dict):
            d = {"vehicle_id": vehicle, "fuel_type": "E10", "is_full_tank": "true", "station_name": "Test",
                 "city": "Munich", "country": "DE", "notes": "", "row_num": i + 2, **e}
        else:
            t, liters, amount = e
            d = {"vehicle_id": vehicle, "event_ts": t, "liters": liters, "amount_eur": amount, "fuel_type": "E10",
                 "is_full_tank": "true", "station_name": "Test", "city": "Munich", "country": "DE", "notes": "",
                 "row_num": i + 2}
        ts = dt(d["event_ts"]) if isinstance(d["event_ts"], str) else d["event_ts"]
        rows.append((d["vehicle_id"], ts, float(d["amount_eur"]), float(d["liters"]),
                     float(d["amount_eur"]) / float(d["liters"]), d["fuel_type"], d["is_full_tank"],
                     d["station_name"], d["city"], d["country"], d["notes"], d["row_num"]))
    return spark.createDataFrame(rows, FUEL_SCHEMA)


def probes_df(spark, times, vehicle=1):
    return spark.createDataFrame([(vehicle, dt(t), i) for i, t in enumerate(times)],
                                 "vehicle_id long, event_ts timestamp_ntz, row_num long")
