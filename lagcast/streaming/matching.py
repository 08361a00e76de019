"""Matching a response stream to a request stream within a time limit."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators.correlate import microseconds, timeout_error

_REQUEST = ["request_id", "req_ts"]
_ANSWER = ["resp_ts", "probability", "risk"]


def _earliest(rows: pa.Table) -> pa.Table:
    """One row of each request: that with the earliest answer."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in _REQUEST + _ANSWER], null_placement="at_start")
    rows = rows.take(order)
    new = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        same = np.ones(len(rows) - 1, dtype=bool)
        for name in _REQUEST:
            codes = rows[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            same &= codes[1:] == codes[:-1]
        new[1:] = ~same
    return rows.filter(pa.array(new))


def _earliest_of_task(batches):
    """The earliest answer of each request among the matches a task makes in one micro-batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = _earliest(rows if held is None else pa.concat_tables([held, rows]))
    yield from [] if held is None else held.combine_chunks().to_batches()


def correlate_stream(
    requests: DataFrame,
    responses: DataFrame,
    timeout: str = fixed.RESPONSE_TIMEOUT,
    lateness: str = "10 seconds",
) -> DataFrame:
    """Each request of a stream with its first response, or with the timeout error.

    An answer shows in the micro-batch that brings it, the earliest if that brings
    several; later ones change nothing. A timeout shows once the watermarks say that
    no answer within ``timeout`` can still come. Where answers come in the order of
    their times the result is that of ``correlate``, but for requests with the same
    id and time, which count once.

    Both sides are read under one checkpoint, so an answer faster than the reader is
    not lost. Time is cut into slots as long as the timeout, and a response is looked
    for in the request's slot and the next, so the state of an id that holds many rows
    is spread over its slots. The outer join gives matches at once and timeouts at the
    limit; all matches of a request in a micro-batch come from one task, which keeps
    the earliest; what was shown before is known by request until the limit has passed.
    """
    width = microseconds(timeout)
    asked = requests.select("request_id", "req_ts").withWatermark("req_ts", lateness)
    asked = asked.withColumn("slot", F.floor(F.unix_micros("req_ts") / width))
    own = F.floor(F.unix_micros("resp_ts") / width)
    given = (
        responses.select(F.col("request_id").alias("answered_id"), "resp_ts", "probability", "risk")
        .withWatermark("resp_ts", lateness)
        .withColumn("answered_slot", F.explode(F.array(own, own - 1)))
    )
    # Rows without an id must reach the watermark, so the join may not imply an id; they
    # are no answers even to a request with an empty one.
    within = (
        (F.coalesce("answered_id", F.lit("")) == F.col("request_id"))
        & (F.col("answered_slot") == F.col("slot"))
        & F.col("resp_ts").between(F.col("req_ts"), F.col("req_ts") + F.expr(f"interval {timeout}"))
    )
    # Only the request's time goes on as event time; the answer's is a plain column.
    answered = F.col("answered_id").isNotNull()
    matched = asked.join(given, within, "left_outer").select(
        *_REQUEST, *[F.when(answered, F.col(c)).alias(c) for c in _ANSWER]
    )
    earliest = matched.mapInArrow(_earliest_of_task, matched.schema)
    first = earliest.dropDuplicatesWithinWatermark(_REQUEST)
    return first.select(*_REQUEST, *_ANSWER, timeout_error(F.col("resp_ts").isNotNull()).alias("error"))
