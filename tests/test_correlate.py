import datetime
import random

import pytest
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators.correlate import correlate
from lagcast.operators.ordering import next_values

START = datetime.datetime(2024, 1, 1)
REQ = "request_id string, req_ts timestamp"
RESP = "request_id string, resp_ts timestamp, probability double, risk string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(rows, asked, given):
    requests = rows([(i, at(t)) for i, t in asked], REQ)
    responses = rows([(i, at(t), p, "Low") for i, t, p in given], RESP)
    got = correlate(requests, responses).collect()
    return {(r.request_id, (r.req_ts - START).total_seconds()): (r.probability, r.error) for r in got}


def test_match_late_and_missing(rows):
    got = run(
        rows, [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 5)],
        [("a", 3, 0.1), ("b", 20, 0.2), ("d", 10, 0.4), ("e", 4.9, 0.5), ("x", 1, 0.9)],
    )
    late = (None, fixed.TIMEOUT_TEXT)
    assert got == {("a", 0): (0.1, None), ("b", 0): late, ("c", 0): late, ("d", 0): (0.4, None), ("e", 5): late}


def test_first_answer_counts(rows):
    assert run(rows, [("a", 0)], [("a", 5, 0.5), ("a", 2, 0.2), ("a", 2, 0.3)]) == {("a", 0): (0.2, None)}


def test_answer_at_the_same_instant(rows):
    assert run(rows, [("a", 7)], [("a", 7, 0.7)]) == {("a", 7): (0.7, None)}


def test_rows_without_an_id_never_meet(rows):
    late = (None, fixed.TIMEOUT_TEXT)
    assert run(rows, [(None, 0), ("a", 0)], [(None, 3, 0.1)]) == {(None, 0): late, ("a", 0): late}


def test_no_responses(rows):
    assert run(rows, [("a", 0)], []) == {("a", 0): (None, fixed.TIMEOUT_TEXT)}


@pytest.mark.parametrize("seed", range(3))
def test_equals_trying_every_pair(rows, seed):
    """Repeated ids, one of which holds a third of all rows."""
    draw = random.Random(seed)
    ids = ["hot"] * 5 + [f"i{n}" for n in range(10)]
    asked = sorted({(draw.choice(ids), draw.randrange(0, 4000) / 10) for _ in range(300)})
    given = [(draw.choice(ids), draw.randrange(0, 4200) / 10) for _ in range(300)]
    given = [(i, t, round(t / 1000, 6)) for i, t in sorted(set(given))]
    want = {}
    for i, t in asked:
        near = [(s, p) for j, s, p in given if j == i and t <= s <= t + 10.0000001]
        want[i, t] = (min(near)[1], None) if near else (None, fixed.TIMEOUT_TEXT)
    assert run(rows, asked, given) == want


def test_burst_of_one_id_spreads_over_partitions(spark):
    """A third of all rows has one id and lies within ten seconds; most of it at few instants."""
    rng = random.Random(3)
    asked, given = [], []
    for k in range(900):
        hot, t = k % 3 == 0, rng.randrange(100) / 10
        asked.append(("hot" if hot else f"r{k % 37}", at(t if hot else k)))
        if k % 5 == 0:
            given.append(("hot" if hot else f"r{k % 37}", at((t if hot else k) + rng.choice([0, 4, 10, 11])), k / 900, "Low"))
    asked += [(None, at(1))] * 3 + [("silent", at(1))] * 2
    given += [(None, at(2), 0.5, "Low"), ("early", at(0), 0.5, "Low")]
    expected = []
    for name, t in asked:
        fits = [g[1:] for g in given if name is not None and g[0] == name and 0 <= (g[1] - t).total_seconds() <= 10]
        first = min(fits, default=(None,) * 3)
        expected.append((name, t, *first, None if fits else fixed.TIMEOUT_TEXT))
    requests, responses = spark.createDataFrame(asked, REQ).repartition(7), spark.createDataFrame(given, RESP)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        got = correlate(requests, responses).collect()
        moments = responses.select("request_id", "resp_ts").distinct().withColumn("v", F.lit(1))
        placed = next_values(moments, "request_id", "resp_ts", "v", "next").select("request_id").withColumn(
            "part", F.spark_partition_id())
        assert placed.where("request_id = 'hot'").select("part").distinct().count() > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_next_value_is_carried_over_partitions_without_one(rows):
    data = [("a", k, "late" if k == 99 else None) for k in range(100)] + [("b", k, None) for k in range(100)]
    got = next_values(rows(data, "g string, o int, v string").repartition(5), "g", "o", "v", "next").collect()
    assert {(r.g, r.next) for r in got} == {("a", "late"), ("b", None)} and len(got) == 200


def test_plan_has_no_join(rows):
    requests, responses = rows([("a", at(0))], REQ), rows([("a", at(1), 0.5, "Low")], RESP)
    plan = correlate(requests, responses)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
