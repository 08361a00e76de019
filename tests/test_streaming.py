import datetime
import json

import pytest
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators.correlate import correlate
from lagcast.operators.requests import (
    coerce_request, split_bad, valid_request, with_request_defaults, with_request_id,
)
from lagcast.plans.predicting import respond
from lagcast.plans.recipes import RECIPES
from lagcast.plans.training import train_for_service
from lagcast.session import STREAM_SETTINGS
from lagcast.sources.fixture import flights
from lagcast.sources.topics import (
    file_topic, messages, request_stream, response_stream, write_requests, write_responses,
)
from lagcast.streaming.matching import correlate_stream
from lagcast.streaming.serving import dead_letters, score_stream, serve
from test_requests import GOOD

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def model(spark, folder):
    return train_for_service(flights(spark, folder), recipe=RECIPES["service"].sized(1))


@pytest.fixture()
def send(spark, tmp_path):
    """Adds messages to a named topic, each a (seconds, text) pair."""

    def run(name, *timed):
        topic = file_topic(str(tmp_path / name))
        rows = [(text, START + datetime.timedelta(seconds=s)) for s, text in timed]
        df = spark.createDataFrame(rows, "value string, timestamp timestamp")
        df.coalesce(1).write.format("json").options(**topic.options).mode("append").save(topic.path)
        return topic

    return run


def asked(request_id, **changes):
    return json.dumps({**GOOD, "request_id": request_id, **changes})


def test_service_answers_restarts_and_sets_bad_ones_aside(spark, model, send, tmp_path):
    out, letters = file_topic(str(tmp_path / "out")), file_topic(str(tmp_path / "letters"))

    def run():
        source = request_stream(spark, file_topic(str(tmp_path / "in")))
        serve(model, source, out, letters, str(tmp_path / "progress"), availableNow=True).awaitTermination()

    send("in", (0, asked("a")), (1, "{broken"), (2, asked("b", Temperature="nan")))
    run()
    assert {r.request_id for r in response_stream(spark, out, False).collect()} == {"a"}
    run()  # nothing new: nothing is answered twice
    send("in", (3, asked("c", Carrier="never seen")))
    run()
    assert sorted(r.request_id for r in response_stream(spark, out, False).collect()) == ["a", "c"]
    told = sorted(json.loads(r.value)["reason"] for r in messages(spark, letters, False).collect())
    assert told[0] == "bad Temperature" and told[1].startswith("missing request_id") and len(told) == 2


def test_stream_equals_batch(spark, model, send, tmp_path):
    topic = send("in", *[(i, asked(f"r{i}", Hour=i % 24)) for i in range(50)], (60, "?"))
    answers, bad = score_stream(model, request_stream(spark, topic)), dead_letters(model, request_stream(spark, topic))
    out = file_topic(str(tmp_path / "out"))
    write_responses(answers, out, str(tmp_path / "p1"), availableNow=True).awaitTermination()
    good, _ = split_bad(coerce_request(request_stream(spark, topic, False)))
    batch = respond(model, good)
    served = response_stream(spark, out, False).drop("resp_ts")
    assert served.count() == 50 and served.exceptAll(batch).count() == 0
    query = bad.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p2")).trigger(
        availableNow=True).start(str(tmp_path / "bad"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


@pytest.fixture(params=[False, True], ids=["memory", "rocksdb"])
def state(spark, request):
    """The state store that matching uses."""
    for name, value in STREAM_SETTINGS.items() if request.param else ():
        spark.conf.set(name, value)
    yield
    for name in STREAM_SETTINGS:
        spark.conf.unset(name)


def test_matching_with_timeouts_over_restarts(spark, send, tmp_path, state):
    def answer(request_id, p):
        return json.dumps({"request_id": request_id, "probability": p, "risk": "Low"})

    def run():
        asked_in = request_stream(spark, file_topic(str(tmp_path / "asked")))
        given = response_stream(spark, file_topic(str(tmp_path / "given")))
        query = (
            correlate_stream(asked_in, given).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "progress")).outputMode("append")
            .trigger(availableNow=True).start(str(tmp_path / "matched"))
        )
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "matched")).filter(F.col("request_id").isNotNull())
        return {r.request_id: (r.probability, r.error) for r in got.collect()}, got.count()

    send("asked", (0, asked("soon")), (0, asked("late")), (0, asked("never")))
    send("given", (3, answer("soon", 0.3)), (3, answer("soon", 0.3)))
    # The answer shows at once, long before the watermark passes its limit of ten seconds.
    assert run() == ({"soon": (0.3, None)}, 1)
    send("given", (2, answer("soon", 0.2)))  # came second
    send("given", (20, answer("late", 0.2)))
    assert run() == ({"soon": (0.3, None)}, 1)
    send("asked", (1000, "{}"))
    send("given", (1000, "{}"))
    timeout = (None, fixed.TIMEOUT_TEXT)
    assert run() == ({"soon": (0.3, None), "late": timeout, "never": timeout}, 3)


def test_earliest_of_the_answers_that_come_together(spark, send, tmp_path):
    def answer(request_id, p):
        return json.dumps({"request_id": request_id, "probability": p, "risk": "Low"})

    send("asked", *[(k, asked(f"r{k % 7}")) for k in range(60)])
    send("given", *[(k + wait, answer(f"r{k % 7}", wait / 10)) for k in range(60) for wait in (6, 3, 9, 3)])
    requests = request_stream(spark, file_topic(str(tmp_path / "asked")))
    responses = response_stream(spark, file_topic(str(tmp_path / "given")))
    correlate_stream(requests, responses).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start(str(tmp_path / "m")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "m"))
    batch = correlate(
        request_stream(spark, file_topic(str(tmp_path / "asked")), False).select("request_id", "req_ts"),
        response_stream(spark, file_topic(str(tmp_path / "given")), False),
    )
    assert got.count() == 60 and got.exceptAll(batch).count() == 0


def test_strict_model_sets_unknown_categories_aside(spark, folder, send, tmp_path):
    strict = train_for_service(flights(spark, folder), recipe=RECIPES["carrier"].sized(1), depth=3)
    topic = send(
        "in", (0, asked("a", Origin="click", Carrier="C1")), (1, asked("b", Origin="moon", Carrier="C1"))
    )
    out, letters = file_topic(str(tmp_path / "out")), file_topic(str(tmp_path / "letters"))
    serve(strict, request_stream(spark, topic), out, letters, str(tmp_path / "p"), "three",
          availableNow=True).awaitTermination()
    assert [r.request_id for r in response_stream(spark, out, False).collect()] == ["a"]
    assert json.loads(messages(spark, letters, False).first().value)["reason"] == "unknown Origin"


def test_defaults_and_validity_on_a_stream(spark, send, tmp_path):
    labels = spark.createDataFrame(
        [("Carrier", "C"), ("Origin", "O"), ("Dest", "D")], "kind string, label string"
    )
    topic = send("in", (0, asked("a")), (1, asked("b", Dest="Z")), (2, '{"request_id": "c"}'))
    stream = request_stream(spark, topic)
    filled = with_request_defaults(stream, labels)
    kept = valid_request(coerce_request(filled), labels).select("request_id", "Month", "Dest")
    kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).trigger(
        availableNow=True).start(str(tmp_path / "kept")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "kept")).collect()))
    assert got == [("a", 7, "D"), ("c", 1, "D")]


def test_ids_and_requests_on_a_stream(spark, send, tmp_path):
    topic = send("in", *[(i, asked("same")) for i in range(20)])
    renamed = with_request_id(request_stream(spark, topic))
    sent = file_topic(str(tmp_path / "sent"))
    write_requests(renamed, sent, str(tmp_path / "p"), availableNow=True).awaitTermination()
    got = request_stream(spark, sent, False).select("request_id", "Origin").distinct().collect()
    assert len(got) == 20 and {r.Origin for r in got} == {"O"}
