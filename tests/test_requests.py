import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lagcast.functions.codec import as_decimal, as_integer
from lagcast.functions.risk import delay_probability, percent, risk_band, verdict
from lagcast.operators.requests import (
    coerce_request, split_bad, valid_request, with_request_defaults, with_request_id,
)
from lagcast.schemas import RAW_REQUEST
from lagcast.sources.requests import requests_df
from lagcast.sources.topics import parse_requests, to_payload

GOOD = dict(
    request_id="r", Carrier="C", Origin="O", Dest="D", Month=7, Hour="12", Temperature=70,
    Wind_Speed="10", Wind_Gust=0.5, Precipitation=0, Ice_Accretion_3hr="0",
)


@pytest.fixture()
def checked(rows):
    def run(*messages):
        texts = [(m if isinstance(m, (str, bytes)) else json.dumps(m),) for m in messages]
        return coerce_request(parse_requests(rows(texts, "value string"))).collect()

    return run


def test_numbers_quoted_or_bare(checked):
    row = checked(GOOD)[0]
    assert row.error is None
    assert (row.Month, row.Hour, row.Temperature, row.Wind_Gust) == (7, 12, 70.0, 0.5)


@pytest.mark.parametrize(
    "field, value, fine",
    [
        ("Hour", "7", True), ("Hour", 7, True), ("Hour", " 7 ", True), ("Hour", "x", False),
        ("Hour", "5.7", False), ("Hour", 5.7, False), ("Hour", None, False), ("Hour", "", False),
        ("Hour", [7], False), ("Hour", "99999999999", False), ("Temperature", "nan", False),
        ("Temperature", "NaN", False), ("Temperature", "1e1", True), ("Temperature", "-.5", True),
        ("Temperature", "1.5f", False), ("Temperature", "1.5d", False), ("Temperature", "0x1p3", False),
        ("Temperature", "inf", True), ("Temperature", "warm", False), ("Temperature", True, False),
        ("Carrier", None, False), ("Carrier", "never seen", True), ("request_id", None, False),
    ],
)
def test_coercion(checked, field, value, fine):
    row = checked({**GOOD, field: value})[0]
    assert (row.error is None) == fine
    if not fine:
        assert field in row.error


def test_bare_json_infinity_and_nan(checked):
    texts = [json.dumps({**GOOD, "Wind_Gust": float(v)}) for v in ("inf", "-inf", "nan")]
    rows = checked(*texts)
    assert [r.Wind_Gust for r in rows[:2]] == [float("inf"), float("-inf")]
    assert [r.error for r in rows] == [None, None, "bad Wind_Gust"]


@pytest.mark.parametrize("text", ["broken", "", "null", "[]", "5", '{"request_id": "r', "{'request_id': 'r'}"])
def test_undecodable_messages_become_dead_letters(checked, text):
    rows = checked(text, GOOD)
    assert rows[0].error.startswith("missing") and rows[0].payload == text
    assert rows[1].error is None


def test_missing_fields_are_all_named(checked):
    assert checked({k: v for k, v in GOOD.items() if k not in ("Dest", "Hour")})[0].error == "missing Dest, missing Hour"


def test_split_loses_nothing(rows):
    texts = [(json.dumps({**GOOD, "Hour": h}),) for h in (1, "x", 2, None)]
    good, bad = split_bad(coerce_request(parse_requests(rows(texts, "value string"))))
    assert good.count() == 2 and bad.count() == 2
    assert set(bad.columns) == {"request_id", "payload", "error"}


def test_bytes_are_decoded(spark):
    df = spark.createDataFrame([(json.dumps({**GOOD, "Carrier": "łódź"}).encode(),)], "value binary")
    assert parse_requests(df).first().Carrier == "łódź"


def test_payload_round_trip(spark):
    sent = requests_df(spark, [GOOD, {"request_id": "s"}])
    back = parse_requests(to_payload(sent, RAW_REQUEST.names)).select(*RAW_REQUEST.names)
    assert back.collect() == sent.collect()


def test_request_ids_differ(spark):
    ids = with_request_id(spark.range(1000)).select("request_id").collect()
    assert len({r.request_id for r in ids}) == 1000


def labels(rows):
    pairs = [("Carrier", "b"), ("Carrier", "a"), ("Origin", "o"), ("Dest", "e"), ("Dest", "d")]
    return rows(pairs, "kind string, label string")


def test_defaults(spark, rows):
    empty = requests_df(spark, [{"request_id": "r"}, {**GOOD, "Month": 3}])
    first, second = with_request_defaults(empty, labels(rows)).orderBy("request_id", F.desc("Month")).collect()[::-1]
    by_default = first if first.Month == "1" else second
    given = second if by_default is first else first
    assert by_default.asDict() == dict(
        request_id="r", Carrier="a", Origin="o", Dest="d", Month="1", Hour="12", Temperature="70",
        Wind_Speed="10", Wind_Gust="0", Precipitation="0", Ice_Accretion_3hr="0",
    )
    assert (given.Carrier, given.Month) == ("C", "3")


def test_valid_requests(spark, rows):
    base = {**GOOD, "Carrier": "a", "Origin": "o", "Dest": "d"}
    asked = [
        base, {**base, "request_id": "edge", "Hour": 23, "Temperature": -10},
        {**base, "request_id": "hour", "Hour": 24}, {**base, "request_id": "cold", "Temperature": -10.1},
        {**base, "request_id": "dest", "Dest": "z"},
    ]
    kept = valid_request(coerce_request(requests_df(spark, asked)), labels(rows))
    assert {r.request_id for r in kept.collect()} == {"r", "edge"}


@pytest.mark.parametrize(
    "scheme, bands",
    [
        ("alert", ["ON_PLAN", "ON_PLAN", "AT_RISK", "AT_RISK", "AT_RISK"]),
        ("three", ["NISKIE", "ŚREDNIE", "ŚREDNIE", "WYSOKIE", "WYSOKIE"]),
        ("extreme", ["NISKIE", "NISKIE", "WYSOKIE", "WYSOKIE", "EKSTREMALNE"]),
        ("service", ["Low", "Low", "High", "High", "High"]),
    ],
)
def test_bands_are_strict(rows, scheme, bands):
    df = rows([(p,) for p in (0.4, 0.5, 0.6, 0.7, 0.71)], "p double")
    assert [r[0] for r in df.select(risk_band(F.col("p"), scheme)).collect()] == bands
    assert rows([(None,)], "p double").select(risk_band(F.col("p"), scheme)).first()[0] is None


def test_texts(rows):
    df = rows([(0.1234, "C", "O", "D")], "p double, Carrier string, Origin string, Dest string")
    p = F.col("p")
    got = df.select(
        percent(p), verdict(p, "alert"), verdict(p, "three"), verdict(p, "extreme"), verdict(p, "service")
    ).first()
    assert list(got) == [
        "12.34%",
        "✅ LOT PLANOWY (Ryzyko: 12.3%)",
        "Ryzyko opóźnienia: NISKIE (12.3%)\nAnaliza dla linii C z lotniska O.",
        "Ryzyko: NISKIE (12.3%)\nTrasa: O -> D linią C.",
        "Ryzyko: NISKIE ✅\nPrawdopodobieństwo opóźnienia: 12.34%",
    ]


def test_probability_from_vector(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([0.3, 0.7]),)], ["probability"])
    assert df.select(delay_probability()).first()[0] == 0.7


def test_messages_are_parsed_once(rows):
    good, _ = split_bad(coerce_request(parse_requests(rows([("{}",)], "value string"))))
    plan = good.filter(F.col("Temperature") > 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_numbers_are_what_python_reads(rows):
    """Random texts: the same ones are numbers, with the same values."""
    draw = random.Random(7)
    pieces = list("0123456789") * 2 + list("+-.eE \t") + ["inf", "nan", "d", "f", "0x", "00"]
    texts = sorted({"".join(draw.choices(pieces, k=draw.randrange(0, 7))) for _ in range(6000)})

    def read(kind, text, low, high):
        try:
            value = kind(text)
        except ValueError:
            return None
        return value if low <= value <= high else None

    inf = float("inf")
    got = rows([(t,) for t in texts], "t string").select("t", as_integer(F.col("t")), as_decimal(F.col("t")))
    for text, whole, number in got.collect():
        plain = re.sub(r"^(\s*[+-]?\d+)\.0*(\s*)$", r"\1\2", text)  # 7.0 is whole
        assert whole == read(int, plain, -(2**31), 2**31 - 1), repr(text)
        assert number == read(float, text, -inf, inf), repr(text)
