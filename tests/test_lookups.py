"""Country dimension lookups and history top-k."""

from __future__ import annotations

from conftest import fuel_df

from fleetlog.operators import lookups as lk


def test_ordered_country_options(spark):
    dim = lk.countries_dimension(spark)
    codes = [r["code"] for r in lk.ordered_options(dim).orderBy("position").collect()]
    assert codes[:6] == ["DE", "AT", "IT", "FR", "HR", "CH"]
    assert codes[6:9] == ["AL", "BE", "BA"]          # Albania, Belgium, Bosnia and Herzegovina
    assert len(codes) == 34


def test_country_name_and_membership(spark):
    dim = lk.countries_dimension(spark)
    df = spark.createDataFrame([("DE",), ("XX",)], "country string")
    names = {r["country"]: r["country_name"] for r in lk.with_country_name(df, dim).collect()}
    assert names == {"DE": "Germany", "XX": "XX"}
    assert [r["country"] for r in lk.known_codes(df, dim).collect()] == ["DE"]
    assert [r["country"] for r in lk.known_codes(df, dim, known=False).collect()] == ["XX"]


def test_recent_history_top_k_newest_first(spark):
    f = fuel_df(spark, [(f"2024-03-{d:02d} 10:00:00", 40, 70) for d in range(1, 11)])
    rows = lk.recent_history(f, k=3).orderBy("recency").collect()
    assert [r["date"] for r in rows] == ["2024-03-10", "2024-03-09", "2024-03-08"]
    assert rows[0]["time"] == "10:00" and rows[0]["datetime"] == "2024-03-10T10:00:00"
