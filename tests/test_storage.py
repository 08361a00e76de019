"""Replacing what a path holds, and both outputs of a micro-batch together."""

import json

import pytest

from lagcast.plans.recipes import RECIPES
from lagcast.plans.training import train_for_service
from lagcast.sources import models
from lagcast.sources.fixture import flights
from lagcast.sources.models import load_model, save_model
from lagcast.sources.storage import KEPT, Storage, publish, published
from lagcast.sources.topics import file_topic, messages, request_stream
from lagcast.sources.vocabularies import read_vocab, write_vocab
from lagcast.streaming import serving
from lagcast.streaming.serving import serve
from test_requests import GOOD


class Crash(Exception):
    pass


def test_readers_find_old_or_new_between_any_two_steps(spark, rows, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "v"), []

    def look(function):
        def run(*args):
            for when in ("before", "after"):
                seen.append([tuple(r.origins) for r in read_vocab(spark, path).collect()])
                if when == "before":
                    done = function(*args)
            return done

        return run

    write_vocab(rows([("Origin", "old")], "kind string, label string"), path)
    for name in ("rename", "delete", "mark"):
        monkeypatch.setattr(Storage, name, look(getattr(Storage, name)))
    write_vocab(rows([("Origin", "new")], "kind string, label string"), path)
    assert seen[0] == [("old",)] and seen[-1] == [("new",)] and all(s in ([("old",)], [("new",)]) for s in seen)


def test_crash_while_writing_leaves_the_old(spark, tmp_path):
    path = str(tmp_path / "p")

    def put(text, fail=False):
        def write(folder):
            spark.createDataFrame([(text,)], "t string").write.json(folder)
            if fail:
                raise Crash

        return write

    assert published(spark, path) is None
    with pytest.raises(Crash):
        publish(spark, path, put("first", fail=True))
    assert published(spark, path) is None
    for k in range(KEPT + 2):
        publish(spark, path, put(f"v{k}"))
    with pytest.raises(Crash):
        publish(spark, path, put("broken", fail=True))
    assert spark.read.json(published(spark, path)).first().t == f"v{KEPT + 1}"
    assert len(Storage(spark).names(f"{path}/current-*")) == KEPT


@pytest.fixture(scope="module")
def model(spark, folder):
    return train_for_service(flights(spark, folder), recipe=RECIPES["service"].sized(1))


def test_model_is_there_while_it_is_replaced(model, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    save_model(model, path)

    def looks(spark, place, write):
        publish(spark, place, lambda folder: (write(folder), load_model(path)))

    monkeypatch.setattr(models, "publish", looks)
    save_model(model, path)
    assert load_model(path).stages[-1].getNumTrees == model.stages[-1].getNumTrees


@pytest.mark.parametrize("crash", ["second write", "record", "first move", "second move"])
def test_both_outputs_of_a_batch_or_none(spark, model, tmp_path, monkeypatch, crash):
    out, letters = file_topic(str(tmp_path / "out")), file_topic(str(tmp_path / "letters"))
    source = file_topic(str(tmp_path / "in"))
    sent = [(json.dumps({**GOOD, "request_id": "a"}),), ("{broken",)]
    df = spark.createDataFrame(sent, "value string").selectExpr("value", "timestamp '2024-01-01' AS timestamp")
    df.write.format("json").options(**source.options).save(source.path)

    def run():
        serve(model, request_stream(spark, source), out, letters, str(tmp_path / "p"), availableNow=True).awaitTermination()

    def shown():
        return [messages(spark, t, False).count() if Storage(spark).names(f"{t.path}/batch=*") else 0 for t in (out, letters)]

    def failing(function, call):
        calls = []

        def run(*args):
            calls.append(1)
            if len(calls) == call:
                raise Crash
            return function(*args)

        return run

    with monkeypatch.context() as patched:
        if crash == "second write":
            patched.setattr(serving, "_stage", failing(serving._stage, 2))
        elif crash == "record":
            patched.setattr(Storage, "mark", failing(Storage.mark, 1))
        else:
            patched.setattr(serving, "_show", failing(serving._show, 1 if crash == "first move" else 2))
        with pytest.raises(Exception, match="Crash"):
            run()
    if crash != "second move":
        assert shown() == [0, 0]
    run()
    assert shown() == [1, 1]
    run()
    assert shown() == [1, 1]
