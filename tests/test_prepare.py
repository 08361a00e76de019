import datetime
import math

import pytest
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators import prepare as prep
from lagcast.schemas import FLIGHTS

NAN = float("nan")
WHOLE = dict(
    DepDelayMinutes=20.0, Time=datetime.datetime(2024, 3, 5, 17, 59), Origin="A", Dest="B",
    Carrier="C", Temperature=50.0, Wind_Speed=5.0, Precipitation=0.0, Visibility=9.0,
    Wind_Gust=1.0, Ice_Accretion_3hr=0.5,
)


@pytest.fixture()
def flights(spark):
    return lambda *changes: spark.createDataFrame([{**WHOLE, **c} for c in changes], FLIGHTS)


def test_label_is_strict(flights):
    delays = [14.9, 15.0, 15.1, None, NAN]
    got = prep.with_label(flights(*[{"DepDelayMinutes": d} for d in delays])).collect()
    assert [r.Label for r in got] == [0.0, 0.0, 1.0, 0.0, 1.0]


def test_filled_gaps_keep_the_row_and_others_cost_it(flights):
    kept = flights({"Wind_Gust": None}, {"Wind_Gust": NAN}, {"Ice_Accretion_3hr": None})
    assert [r.Wind_Gust for r in prep.prepare(kept).collect()] == [0.0, 0.0, 1.0]
    for column in ("Temperature", "Wind_Speed", "Precipitation", "DepDelayMinutes"):
        assert prep.prepare(flights({column: None}, {column: NAN})).count() == 0
    for column in ("Time", "Origin", "Dest", "Carrier"):
        assert prep.prepare(flights({column: None})).count() == 0


def test_only_selected_columns_cost_a_row(flights):
    rows = flights({"Visibility": None}, {"Dest": None}, {"Carrier": None})
    assert prep.prepare(rows, "V1").count() == 2
    assert prep.prepare(rows, "V2").count() == 2
    assert prep.prepare(rows, "V3").count() == 1


def test_same_rows_as_na_functions(flights):
    rows = flights({}, {"Temperature": None}, {"Temperature": NAN}, {"Wind_Gust": NAN}, {"Dest": None})
    chosen = prep.select_features(rows)
    other = chosen.na.fill(0.0, list(fixed.FILLED_COLUMNS)).dropna()
    mine = prep.drop_incomplete(prep.fill_weather(chosen))
    assert mine.exceptAll(other).count() == 0 and other.exceptAll(mine).count() == 0


def test_time_parts(flights):
    row = prep.prepare(flights({})).first()
    assert (row.Month, row.Hour, row.Label) == (3, 17, 1.0)


def test_hour_ignores_the_session_zone(spark, flights):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert prep.with_time_parts(flights({})).first().Hour == 17
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_null_tests_reach_the_scan(spark, flights, tmp_path):
    flights({}).write.parquet(str(tmp_path / "f"))
    plan = prep.prepare(spark.read.parquet(str(tmp_path / "f")), "V3")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for column in ("DepDelayMinutes", "Time", "Origin"):
        assert f"IsNotNull({column})" in pushed
    assert "Visibility" not in pushed  # pruned
    assert "Exchange" not in plan


def test_peek_and_constant_and_class(flights):
    rows = prep.prepare(flights(*[{"DepDelayMinutes": float(d)} for d in range(10, 20)]))
    assert prep.peek(rows).count() == 5
    assert prep.filter_class(rows, 1).count() == 4
    assert prep.with_constant(rows, "one", 1).agg(F.sum("one")).first()[0] == 10


def test_empty_input(flights, spark):
    assert prep.prepare(spark.createDataFrame([], FLIGHTS)).count() == 0
    assert not math.isnan(prep.prepare(flights({})).first().Wind_Gust)
