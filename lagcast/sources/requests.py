"""Scoring input from request records."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.schemas import RAW_REQUEST


def requests_df(
    spark: SparkSession, records: DataFrame | Iterable[Mapping[str, object]]
) -> DataFrame:
    """Request records as one table in wire form, every field as text.

    Records are a table, or the mappings of an interactive session. Fields the
    records lack are null; the coercion step tells what is wrong with a row.
    """
    if not isinstance(records, DataFrame):
        rows = [
            tuple(None if r.get(n) is None else str(r[n]) for n in RAW_REQUEST.names)
            for r in records
        ]
        return spark.createDataFrame(rows, RAW_REQUEST)
    given = set(records.columns)
    return records.select(
        *[
            (F.col(n).cast("string") if n in given else F.lit(None).cast("string")).alias(n)
            for n in RAW_REQUEST.names
        ]
    )
