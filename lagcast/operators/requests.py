"""Requests: ids, defaults, checks, and the separation of bad ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.functions.codec import as_decimal, as_integer
from lagcast.functions.once import with_computed
from lagcast.schemas import CATEGORY_FIELDS, DECIMAL_FIELDS, INTEGER_FIELDS
from lagcast.session import settled


def with_request_id(df: DataFrame, *place: str | Column) -> DataFrame:
    """A new id per request.

    ``place`` says where a request lies in its source: topic, partition and offset, or
    the path of a file and the row's index in it. The id is a hash of that, so a task
    that is computed again, or a batch that is read again, gives the same ids. Without a
    place ids are random, and a recomputed row draws another: send them before use.
    """
    if not place:
        return df.withColumn("request_id", F.expr("uuid()"))
    spot = F.md5(F.to_json(F.struct(*place), {"ignoreNullFields": "false"}))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return df.withColumn("request_id", F.concat_ws("-", *[F.substring(spot, *cut) for cut in cuts]))


def with_request_defaults(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Fields a request lacks, filled in: fixed values and the first label A to Z.

    ``labels`` are ``(kind, label)`` rows; the first ones enter as one scalar
    subquery.
    """
    first = labels.agg(
        F.struct(
            *[F.min(F.when(F.col("kind") == c, F.col("label"))).alias(c) for c in CATEGORY_FIELDS]
        ).alias("first")
    ).scalar()
    filled = {c: F.coalesce(F.col(c), first.getField(c)) for c in CATEGORY_FIELDS}
    filled |= {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fixed.REQUEST_DEFAULTS.items()}
    return df.withColumns(filled)


def coerce_request(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Text fields to numbers, and in ``error`` what kept a request from scoring.

    Fields that are missing, are not numbers, or are NaN are named; ``error`` is
    null for a good request. Nothing raises, so no message can end a stream.
    ``extra`` names further number fields a request must have.
    """
    numbers = {c: as_integer(F.col(c)) for c in INTEGER_FIELDS}
    numbers |= {c: as_decimal(F.col(c)) for c in (*DECIMAL_FIELDS, *extra)}
    others = [c for c in df.columns if c not in numbers]
    typed = with_computed(df, {f"_{c}": n for c, n in numbers.items()}, *df.columns)
    faults = []
    for c in ("request_id", *CATEGORY_FIELDS, *numbers):
        fault = F.when(F.col(c).isNull(), F.lit(f"missing {c}"))
        faults.append(fault.when(F.col(f"_{c}").isNull(), F.lit(f"bad {c}")) if c in numbers else fault)
    error = F.nullif(F.concat_ws(", ", *faults), F.lit(""))
    return typed.select(*others, *[F.col(f"_{c}").alias(c) for c in numbers], error.alias("error"))


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coerced requests fit for scoring, and dead letters with the reason."""
    good = df.filter(F.col("error").isNull()).drop("error")
    kept = [c for c in ("request_id", "payload", "req_ts", "error") if c in df.columns]
    return good, df.filter(F.col("error").isNotNull()).select(*kept)


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    """Whether all fields lie in their ranges, ends included."""
    inside = F.lit(True)
    for name, (low, high) in ranges.items():
        inside = inside & F.col(name).between(low, high)
    return inside


def valid_request(
    df: DataFrame,
    labels: DataFrame,
    ranges: dict[str, tuple[float, float]] | None = None,
    kinds: tuple[str, ...] = CATEGORY_FIELDS,
) -> DataFrame:
    """Coerced requests within the input ranges and with known categories.

    ``labels`` are ``(kind, label)`` rows. They are computed once; whether a kind's
    labels are broadcast follows from their size, which is known then.
    """
    kept = df.filter(in_ranges(ranges or fixed.INPUT_RANGES["route"]))
    stored = settled(labels.filter(F.col("kind").isin(*kinds)).select("kind", "label").distinct())
    for kind in kinds:
        known = stored.filter(F.col("kind") == kind).select(F.col("label").alias(kind))
        kept = kept.join(known, kind, "left_semi")
    return kept.select(*df.columns)
