"""The two services from files to answers."""

import json

from lagcast.functions.risk import risk_band
from lagcast.jobs import serve, train
from lagcast.sources.fixture import flights
from lagcast.sources.requests import requests_df
from lagcast.sources.topics import file_topic, response_stream, write_requests
from lagcast.sources.vocabularies import read_vocab
from pyspark.sql import functions as F
from test_requests import GOOD


def test_train_then_serve(spark, folder, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("csv", "model", "copy", "vocabulary", "progress")}
    flights(spark, folder).drop("event_id").write.option("header", "true").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(paths["csv"])
    train.run(spark, paths["csv"], paths["model"], paths["copy"], rounds=1)

    asked, answers, letters = (file_topic(str(tmp_path / n)) for n in ("asked", "answers", "letters"))
    known = {**GOOD, "Origin": "click", "Dest": "D1", "Carrier": "C1"}
    write_requests(requests_df(spark, [known, {**known, "request_id": "x", "Hour": "?"}]), asked)
    serve.run(spark, paths["model"], paths["vocabulary"], asked, answers, letters, paths["progress"],
              availableNow=True).awaitTermination()

    got = response_stream(spark, answers, False).withColumn("band", risk_band(F.col("probability"))).collect()
    assert [(r.request_id, r.risk == r.band) for r in got] == [("r", True)]
    stored = read_vocab(spark, paths["vocabulary"]).first()
    assert stored.origins == ["click", "error", "purchase", "signup", "view"]
    assert stored.carriers == sorted(stored.carriers) and len(stored.carriers) == 17
    letter = spark.read.json(letters.path).first()
    assert json.loads(letter.value)["reason"] == "bad Hour"
