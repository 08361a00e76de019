"""Topics kept as logs: newest and earliest offset, restarts, and ids from places."""

import pytest
from pyspark.sql import functions as F

from lagcast.operators.requests import with_request_id
from lagcast.sources import log
from lagcast.sources.topics import PLACE, log_topic, messages, write_messages


@pytest.fixture()
def send(spark, tmp_path):
    def run(*values):
        df = spark.createDataFrame([(v, v) for v in values], "key string, value string")
        write_messages(df, log_topic(str(tmp_path / "log")))

    return run


def drain(df, tmp_path, name):
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-p")).trigger(
        availableNow=True).start(str(tmp_path / name)).awaitTermination()


def test_newest_offset_and_restart(spark, send, tmp_path):
    latest, earliest = (log_topic(str(tmp_path / "log"), starting) for starting in ("latest", "earliest"))
    names = {"new": latest, "all": earliest}

    def seen():
        for name, topic in names.items():
            drain(messages(spark, topic).select("value"), tmp_path, name)
        read = spark.read.schema("value string")
        return [sorted(r.value for r in read.parquet(str(tmp_path / name)).collect()) for name in names]

    send("a", "b", "c")
    assert seen() == [[], ["a", "b", "c"]]  # what was there before is skipped
    send("d")
    send("b")
    assert seen() == [["b", "d"], ["a", "b", "b", "c", "d"]]
    assert seen() == [["b", "d"], ["a", "b", "b", "c", "d"]]  # nothing new: nothing twice


def test_offsets_have_no_gaps_and_can_be_read_again(spark, send, tmp_path):
    for k in range(3):
        send(*[f"m{i}" for i in range(k * 10, k * 10 + 20)])
    path = str(tmp_path / "log")
    rows = messages(spark, log_topic(path), False).collect()
    by_partition = {}
    for r in rows:
        by_partition.setdefault(r.partition, []).append(r.offset)
    assert len(rows) == 60 and len(by_partition) > 1
    assert all(sorted(found) == list(range(len(found))) for found in by_partition.values())
    some = next(p for p, found in by_partition.items() if len(found) > 4)
    again = [b for b in log.Log(path).read(log.Span(some, 1, 4))]
    assert sorted(x for b in again for x in b.column("offset").to_pylist()) == [1, 2, 3]
    assert log.Log("file:" + path).ends() == {str(p): len(found) for p, found in by_partition.items()}
    assert log.Log(str(tmp_path / "nothing")).ends() == {}


def test_ids_from_places_stay(spark, send, tmp_path):
    send(*["same"] * 20, *[f"m{k}" for k in range(20)])
    placed = messages(spark, log_topic(str(tmp_path / "log")), False)
    ids = [
        {(r.partition, r.offset): r.request_id for r in with_request_id(df, *PLACE).collect()}
        for df in (placed, placed.repartition(7))
    ]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 40
    assert with_request_id(placed.select("value")).select(F.count_distinct("request_id")).first()[0] == 40
