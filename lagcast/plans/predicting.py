"""Scoring requests as a table."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.functions.risk import delay_probability, risk_band, verdict
from lagcast.operators.features import indexer_of, inputs_of, labels_of
from lagcast.operators.requests import coerce_request
from lagcast.operators.trees import score
from lagcast.schemas import CATEGORY_FIELDS, EXTRA_FIELDS


def respond(model: PipelineModel, good: DataFrame, scheme: str = "service") -> DataFrame:
    """Responses to coerced requests. Row by row, so it works on streams too."""
    scored = score(model, good).withColumn("p", delay_probability())
    return scored.select(
        "request_id", F.col("p").alias("probability"), risk_band(F.col("p"), scheme).alias("risk")
    )


def _with_unknown(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """``requests`` with ``unknown``: the categories a model that raises at unseen values would raise at.

    A copy of the fitted indexer gives such values the index behind the last label.
    """
    if indexer_of(model).getHandleInvalid() != "error":
        return requests.withColumn("unknown", F.lit(None).cast("string"))
    labels = labels_of(model)
    looked = {f"_at_{kind}": kind for kind in labels}
    finder = indexer_of(model).copy().setHandleInvalid("keep").setOutputCols(list(looked))
    faults = [
        F.when(F.col(kind).isNotNull() & (F.col(at) == len(labels[kind])), F.lit(f"unknown {kind}"))
        for at, kind in looked.items()
    ]
    found = finder.transform(requests)
    return found.withColumn("unknown", F.nullif(F.concat_ws(", ", *faults), F.lit(""))).drop(*looked)


def _missing_inputs(model: PipelineModel, requests: DataFrame) -> dict[str, Column]:
    """Stand-ins for columns ``requests`` lacks: blank where the model ignores them."""
    unused = [c for c in CATEGORY_FIELDS if c not in labels_of(model)]
    lacking = [c for c in EXTRA_FIELDS if c in inputs_of(model) and c not in requests.columns]
    return {c: F.lit("") for c in unused} | {c: F.lit(None).cast("string") for c in lacking}


def check_requests(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Requests in wire form with typed fields, and in ``error`` what a model cannot take.

    Categories the model does not use may be missing; a model that uses
    visibility asks for it; one that raises at unseen categories gets none.
    """
    extra = tuple(c for c in EXTRA_FIELDS if c in inputs_of(model))
    complete = requests.withColumns(_missing_inputs(model, requests))
    checked = _with_unknown(model, coerce_request(complete, extra))
    return checked.withColumn("error", F.coalesce("error", "unknown")).drop("unknown")


def _stand_ins(model: PipelineModel, checked: DataFrame) -> dict[str, Column]:
    """Model inputs, with values any model takes where the request is bad."""
    fine = F.col("error").isNull()
    numbers = [c for c in inputs_of(model) if c in checked.columns]
    known = {c: F.lit(labels[0]) for c, labels in labels_of(model).items()}
    known |= {c: F.lit(0).cast(checked.schema[c].dataType) for c in numbers}
    return {c: F.when(fine, F.col(c)).otherwise(value) for c, value in known.items()}


def predict(model: PipelineModel, requests: DataFrame, scheme: str) -> DataFrame:
    """Probability, band and verdict per request; for a bad request an error text.

    Bad rows go through the model with stand-in values and get no probability,
    so that requests are read once and one bad row never costs the others.
    """
    checked = check_requests(model, requests)
    scored = score(model, checked.withColumns(_stand_ins(model, checked)))
    p = F.col("p")
    return scored.withColumn("p", F.when(F.col("error").isNull(), delay_probability())).select(
        "request_id",
        p.alias("probability"),
        risk_band(p, scheme).alias("risk"),
        F.coalesce(verdict(p, scheme), F.format_string(fixed.ERROR_TEXT, "error")).alias("verdict"),
        "error",
    )
