"""Message topics: a broker in service, logs or folders of files in tests.

A topic is a Spark source or sink and its options. Sources give ``value`` and
``timestamp`` columns; sinks take ``key`` and ``value``.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagcast.functions.codec import decode, encode
from lagcast.functions.once import with_fields
from lagcast.schemas import MESSAGE, RAW_REQUEST, RESPONSE
from lagcast.sources import log


# JSON files keep milliseconds unless told otherwise.
_MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


@dataclass(frozen=True)
class Topic:
    """Where messages are read from or written to."""

    format: str
    options: dict = field(default_factory=dict)
    path: str | None = None


def kafka_source(servers: str, topic: str, starting: str = "latest", **options) -> Topic:
    """A broker topic to read; by default only what arrives from now on.

    ``starting`` matters at the first start only: later starts go on from the
    offsets in the query's checkpoint.
    """
    return Topic(
        "kafka",
        {
            "kafka.bootstrap.servers": servers,
            "subscribe": topic,
            "startingOffsets": starting,
            **options,
        },
    )


def kafka_sink(servers: str, topic: str, **options) -> Topic:
    """A broker topic to write."""
    return Topic("kafka", {"kafka.bootstrap.servers": servers, "topic": topic, **options})


def log_topic(path: str, starting: str = "latest", partitions: int = 4) -> Topic:
    """A log on storage, with offsets; a stream reads what arrives from its first start on."""
    return Topic(log.FORMAT, {"path": path, "startingOffsets": starting, "partitions": str(partitions)})


def file_topic(path: str, **options) -> Topic:
    """A folder of JSON-lines files of messages, which stands for a topic."""
    return Topic("json", {"timestampFormat": _MICROSECONDS, **options}, path)


# Where a message lies in its topic; sources without offsets do not say.
PLACE = ("topic", "partition", "offset")


def messages(spark: SparkSession, topic: Topic, streaming: bool = True) -> DataFrame:
    """Raw messages of a topic: text, the time the topic took them in, and their place if it has one."""
    if topic.format == log.FORMAT:
        spark.dataSource.register(log.LogSource)
    reader = (spark.readStream if streaming else spark.read).format(topic.format)
    if topic.path is not None:
        reader = reader.schema(MESSAGE)
    source = reader.options(**topic.options).load(topic.path)
    place = [c for c in PLACE if c in source.columns]
    return source.select(F.col("value").cast("string").alias("value"), "timestamp", *place)


def request_stream(spark: SparkSession, topic: Topic, streaming: bool = True) -> DataFrame:
    """Requests of a topic in wire form, with the message and its time."""
    return parse_requests(messages(spark, topic, streaming))


def response_stream(spark: SparkSession, topic: Topic, streaming: bool = True) -> DataFrame:
    """Responses of a topic with the time each came in."""
    received = messages(spark, topic, streaming).withColumnRenamed("timestamp", "resp_ts")
    return with_fields(received, decode(F.col("value"), RESPONSE), "resp_ts")


def parse_requests(source: DataFrame) -> DataFrame:
    """Messages decoded to request fields as text.

    ``payload`` keeps the message, ``req_ts`` the time it came in if there is one, and
    its place in the topic stays.
    """
    received = source.withColumnsRenamed({"value": "payload", "timestamp": "req_ts"})
    received = received.withColumn("payload", F.col("payload").cast("string"))
    kept = [c for c in ("payload", "req_ts", *PLACE) if c in received.columns]
    return with_fields(received, decode(F.col("payload"), RAW_REQUEST), *kept)


def to_payload(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Records as messages: the id as key, so one request's messages stay together."""
    named = fields or df.columns
    return df.select(
        F.col("request_id").cast("string").alias("key"), encode(*named).alias("value")
    )


def _send(df: DataFrame, topic: Topic) -> None:
    if topic.format == log.FORMAT:
        timed = df.withColumn("timestamp", F.current_timestamp())
        return log.append(timed, topic.options["path"], int(topic.options["partitions"]))
    if topic.path is not None:
        df = df.withColumn("timestamp", F.current_timestamp())
    df.write.format(topic.format).options(**topic.options).mode("append").save(topic.path)


def _send_stream(df: DataFrame, topic: Topic, checkpoint: str, trigger: dict) -> StreamingQuery:
    if topic.path is not None:
        df = df.withColumn("timestamp", F.current_timestamp())
    writer = (
        df.writeStream.format(topic.format)
        .options(**topic.options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
    )
    return writer.start(topic.path)


def write_messages(
    df: DataFrame, topic: Topic, checkpoint: str | None = None, **trigger
) -> StreamingQuery | None:
    """Send a table at once, or a stream as a query that goes on from its checkpoint."""
    if not df.isStreaming:
        return _send(df, topic)
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder on shared storage")
    return _send_stream(df, topic, checkpoint, trigger or {"processingTime": "0 seconds"})


def write_requests(df: DataFrame, topic: Topic, checkpoint: str | None = None, **trigger):
    """Send requests to a topic."""
    return write_messages(to_payload(df, RAW_REQUEST.names), topic, checkpoint, **trigger)


def write_responses(df: DataFrame, topic: Topic, checkpoint: str | None = None, **trigger):
    """Send responses to a topic."""
    return write_messages(to_payload(df, RESPONSE.names), topic, checkpoint, **trigger)
