"""Matching responses to requests within a time limit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagcast import fixed
from lagcast.operators.ordering import next_values


def timeout_error(answered: Column, text: str = fixed.TIMEOUT_TEXT) -> Column:
    """Null for an answered request, the timeout text for others."""
    return F.when(~answered, F.lit(text))


def microseconds(interval: str) -> int:
    """An interval such as ``10 seconds`` in microseconds."""
    amount, unit = interval.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1_000_000


def _answer_type(responses: DataFrame) -> T.StructType:
    fields = responses.schema
    return T.StructType([fields["resp_ts"], fields["probability"], fields["risk"]])


def correlate(
    requests: DataFrame, responses: DataFrame, timeout: str = fixed.RESPONSE_TIMEOUT
) -> DataFrame:
    """Each request with the first response of its id within ``timeout``.

    Requests are ``(request_id, req_ts)``, responses ``(request_id, resp_ts,
    probability, risk)``. A request without one gets the timeout error, and so does
    one without an id.

    Instead of a join, whose output grows with the product of the rows of a
    repeated id, both sides are laid on one time line. All rows of an id at one
    instant become one on the way to it: the number of requests and the lowest
    answer. The time line is range-partitioned by id and time, so a burst of one id
    spreads over tasks, and an answer from a later partition is carried back.
    """
    width = microseconds(timeout)
    asked = requests.select(
        "request_id",
        F.unix_micros(F.col("req_ts").cast("timestamp")).alias("at"),
        "req_ts",
        F.lit(None).cast(_answer_type(responses)).alias("answer"),
    )
    # A response without an id answers nothing; a repeated one changes nothing.
    given = responses.where(F.col("request_id").isNotNull()).select(
        "request_id",
        F.unix_micros(F.col("resp_ts").cast("timestamp")).alias("at"),
        F.lit(None).cast(requests.schema["req_ts"].dataType).alias("req_ts"),
        F.struct("resp_ts", "probability", "risk").alias("answer"),
    )
    moments = asked.unionByName(given).groupBy("request_id", "at").agg(
        F.max("req_ts").alias("req_ts"), F.count("req_ts").alias("times"), F.min("answer").alias("answer")
    )
    found = next_values(moments, "request_id", "at", "answer", "next").where("times > 0")
    in_time = F.unix_micros(F.col("next.resp_ts").cast("timestamp")) - F.col("at") <= width
    answer = F.when(in_time, F.col("next")).alias("answer")
    each = found.select("request_id", "req_ts", answer, F.explode(F.sequence(F.lit(1), "times")))
    return each.select(
        "request_id", "req_ts", "answer.resp_ts", "answer.probability", "answer.risk",
        timeout_error(F.col("answer").isNotNull()).alias("error"),
    )
