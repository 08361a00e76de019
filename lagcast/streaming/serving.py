"""Scoring a stream of requests, with bad ones set aside."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagcast.functions.codec import encode
from lagcast.operators.requests import split_bad
from lagcast.plans.predicting import check_requests, respond
from lagcast.schemas import RESPONSE
from lagcast.session import held
from lagcast.sources.storage import Storage
from lagcast.sources.topics import Topic, to_payload


def score_stream(model: PipelineModel, requests: DataFrame, scheme: str = "service") -> DataFrame:
    """Responses to the good requests of a stream: stateless, one row per row."""
    good, _ = split_bad(check_requests(model, requests))
    return respond(model, good, scheme)


def dead_letters(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """The requests of a stream the model cannot take, with the message and the reason."""
    _, bad = split_bad(check_requests(model, requests))
    return bad


def _stage(df: DataFrame, sink: Topic, batch: int) -> None:
    """Send one micro-batch to a broker, or write it where readers of a folder do not look."""
    if sink.path is None:
        df.write.format(sink.format).options(**sink.options).mode("append").save()
        return
    timed = df.withColumn("timestamp", F.current_timestamp())
    timed.write.format(sink.format).options(**sink.options).mode("overwrite").save(f"{sink.path}/_staged/{batch}")


def _show(storage: Storage, sink: Topic, batch: int) -> None:
    """Move a staged micro-batch to where readers look, under its number; nothing if that is done."""
    if sink.path is None or not storage.exists(f"{sink.path}/_staged/{batch}"):
        return
    storage.delete(f"{sink.path}/batch={batch}")  # of a stream that had another checkpoint
    storage.rename(f"{sink.path}/_staged/{batch}", f"{sink.path}/batch={batch}")


def _as_letters(bad: DataFrame) -> DataFrame:
    """Dead letters as messages: what came in, and the reason it was set aside."""
    letter = encode("payload", F.col("error").alias("reason"))
    return bad.select(F.col("request_id").alias("key"), letter.alias("value"))


def serve(
    model: PipelineModel,
    requests: DataFrame,
    responses: Topic,
    letters: Topic,
    checkpoint: str,
    scheme: str = "service",
    **trigger,
) -> StreamingQuery:
    """Answer a request stream: responses to one topic, dead letters to another.

    Each micro-batch is read and coerced once and written twice. Folders get both
    parts or none: they are staged, a record of the batch is renamed into the
    checkpoint, and only then are they moved to where readers look. A restart writes
    a batch without a record anew, and of one with a record does the moves that are
    left. A broker may get the last batch again after a restart; its readers take the
    first answer to an id. The query holds the model it was started with; restart it
    to change the model.
    """
    storage = Storage(requests.sparkSession)

    def handle(batch: DataFrame, number: int) -> None:
        record = f"{checkpoint.rstrip('/')}/sent/{number}"
        if not storage.exists(record):
            with held(check_requests(model, batch)) as checked:
                good, bad = split_bad(checked)
                _stage(to_payload(respond(model, good, scheme), RESPONSE.names), responses, number)
                _stage(_as_letters(bad), letters, number)
            storage.mark(record)
        for sink in (responses, letters):
            _show(storage, sink, number)
        storage.delete(f"{checkpoint.rstrip('/')}/sent/{number - 2}")  # only the last batch can come again

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "0 seconds"}))
        .start()
    )
