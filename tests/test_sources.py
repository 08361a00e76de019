import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagcast import fixed
from lagcast.schemas import FLIGHTS
from lagcast.sources.flights import columnar_copy, read_flights, schema_report
from lagcast.sources.fixture import flights
from lagcast.sources.models import load_model
from lagcast.sources.requests import requests_df
from lagcast.sources.topics import file_topic, kafka_sink, kafka_source, messages, write_requests
from lagcast.sources.vocabularies import read_labels, read_vocab, vocabulary_labels, write_vocab

HEADER = ",".join(FLIGHTS.names)
LINE = "20,2024-03-05 17:00:00,A,B,C,50,5,0,9,,"


def put(folder, name, *lines):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text("\n".join(lines) + "\n")
    return str(folder)


def test_nested_csv_with_declared_types(spark, tmp_path):
    put(tmp_path, "a.csv", HEADER, LINE)
    path = put(tmp_path, "deep/er/b.csv", HEADER, LINE, LINE)
    df = read_flights(spark, path)
    assert df.schema == FLIGHTS and df.count() == 3
    row = df.first()
    assert row.Time == datetime.datetime(2024, 3, 5, 17) and row.Wind_Gust is None


@pytest.mark.parametrize("explicit", [True, False])
def test_swapped_headers_fail_loudly(spark, tmp_path, explicit):
    swapped = FLIGHTS.names[:]
    swapped[5], swapped[6] = swapped[6], swapped[5]
    put(tmp_path, "a.csv", HEADER, LINE)
    path = put(tmp_path, "b.csv", ",".join(swapped), LINE)
    with pytest.raises(Exception, match="header"):
        read_flights(spark, path, FLIGHTS if explicit else None).collect()


def test_files_come_together_by_name(spark, tmp_path):
    swapped = FLIGHTS.names[:]
    swapped[5], swapped[6] = swapped[6], swapped[5]
    put(tmp_path, "a b+c[1].csv", HEADER, LINE)
    put(tmp_path, "deep/b.csv", ",".join(swapped), LINE)
    put(tmp_path, "c.csv", "Tail," + HEADER, "N1," + LINE, "N2," + LINE)
    (tmp_path / "empty.csv").write_text("")
    path = put(tmp_path, "d.csv", HEADER)
    df = read_flights(spark, path, by_name=True)
    got = sorted((r.Tail or "", r.Temperature, r.Wind_Speed) for r in df.collect())
    assert got == [("", 5.0, 50.0), ("", 50.0, 5.0), ("N1", 50.0, 5.0), ("N2", 50.0, 5.0)]
    same = read_flights(spark, path, infer=True)
    assert same.schema["Temperature"].dataType == T.IntegerType()
    assert sorted((r.Tail or "", r.Temperature, r.Wind_Speed) for r in same.collect()) == got


def test_inferred_type_holds_the_values_of_all_files(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y,z", "1,2024-01-01,7")
    path = put(tmp_path, "b.csv", "z,x,y", "p,2.5,2024-01-01 10:00:00")
    df = read_flights(spark, path, infer=True)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"x": "double", "y": "timestamp", "z": "string"}
    assert sorted((r.x, r.z) for r in df.collect()) == [(1.0, "7"), (2.5, "p")]


def test_other_columns_are_carried_as_text(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Tail," + HEADER, "N1," + LINE)
    df = read_flights(spark, path)
    assert df.first().Tail == "N1" and df.schema["Temperature"].dataType == T.DoubleType()


def test_unreadable_number_is_a_gap(spark, tmp_path):
    path = put(tmp_path, "a.csv", HEADER, LINE.replace(",50,", ",M,"))
    row = read_flights(spark, path).first()
    assert row.Temperature is None and row.Wind_Speed == 5.0


def test_schema_report_of_inferred_types(spark, tmp_path):
    path = put(tmp_path, "a.csv", HEADER, LINE)
    got = {r.name: r.type for r in schema_report(read_flights(spark, path, infer=True)).collect()}
    assert got["Time"] == "timestamp" and got["Temperature"] == "int" and got["Origin"] == "string"


def test_columnar_copy(spark, folder, tmp_path):
    rows = flights(spark, folder)
    copy = columnar_copy(rows, str(tmp_path / "copy"))
    assert copy.schema == rows.schema and copy.exceptAll(rows).count() == 0
    assert len(columnar_copy(rows, str(tmp_path / "five"), files=5).inputFiles()) == 5


def test_request_records(spark):
    one = requests_df(spark, [{"request_id": "a", "Month": 3, "Hour": None}]).first()
    assert (one.request_id, one.Month, one.Hour, one.Dest) == ("a", "3", None, None)


def labels(rows):
    return rows([("Origin", "b"), ("Origin", "a"), ("Carrier", "c")], "kind string, label string")


def test_vocabulary_object(spark, rows, tmp_path):
    path = str(tmp_path / "v")
    write_vocab(labels(rows), path)
    assert read_vocab(spark, path).first().asDict() == {"origins": ["a", "b"], "dests": [], "carriers": ["c"]}
    write_vocab(labels(rows).filter("kind = 'Origin'"), path)  # replaces
    assert read_vocab(spark, path).first().carriers == []


@pytest.mark.parametrize("form", ["object", "rows"])
def test_labels_of_either_form(spark, rows, tmp_path, form):
    path = str(tmp_path / "v")
    write_vocab(labels(rows), path, form=form)
    got = sorted(map(tuple, read_labels(spark, path).collect()))
    assert got == [("Carrier", "c"), ("Origin", "a"), ("Origin", "b")]
    assert read_vocab(spark, path).first().asDict() == {"origins": ["a", "b"], "dests": [], "carriers": ["c"]}


def test_absent_vocabulary_is_empty(spark, tmp_path):
    stored = read_vocab(spark, str(tmp_path / "nothing"))
    assert stored.first().asDict() == {"origins": [], "dests": [], "carriers": []}
    assert vocabulary_labels(stored).count() == 0


def test_absent_model_fails_at_once(tmp_path):
    with pytest.raises(Exception):
        load_model(str(tmp_path / "nothing"))


def test_broker_topics():
    source = kafka_source("host:9092", fixed.REQUEST_TOPIC)
    assert source.format == "kafka" and source.path is None
    assert source.options["subscribe"] == "predict_requests"
    assert source.options["startingOffsets"] == "latest"
    assert kafka_source("h", "t", "earliest").options["startingOffsets"] == "earliest"
    assert kafka_sink("host:9092", fixed.RESPONSE_TOPIC).options["topic"] == "predict_responses"


def test_stream_needs_a_checkpoint(spark, tmp_path):
    topic = file_topic(str(tmp_path / "t"))
    write_requests(requests_df(spark, [{"request_id": "a"}]), topic)
    stream = messages(spark, topic).select(F.col("value").alias("request_id"))
    with pytest.raises(ValueError, match="checkpoint"):
        write_requests(stream.select("request_id", *[F.lit("1").alias(n) for n in (
            "Carrier", "Origin", "Dest", "Month", "Hour", "Temperature", "Wind_Speed", "Wind_Gust",
            "Precipitation", "Ice_Accretion_3hr")]), topic)
