"""Quality of scores."""

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators.ordering import preceding_totals


def score_counts(df: DataFrame, score: str = "score", label: str = "Label") -> DataFrame:
    """Positives and negatives per distinct score; rows without either are left out."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    positive = F.col(label) > 0.5
    return known.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives")
    )


def auc(df: DataFrame, score: str = "score", label: str = "Label") -> DataFrame:
    """Exact area under the ROC curve, with the class sizes.

    The share of (positive, negative) pairs that the score puts in order, equal
    scores counting half. No pairs are formed: rows are counted per score, and
    negatives below each score come from a running total. Sums are whole
    numbers of 38 digits, so the result does not depend on the order of adding
    and does not overflow. Null where a class is missing.
    """
    ranked = preceding_totals(
        score_counts(df, score, label), [F.asc("score")], {"below": "negatives"}
    )
    wide = "decimal(19,0)"
    doubled = F.col("positives").cast(wide) * (F.lit(2) * F.col("below") + F.col("negatives")).cast(wide)
    sums = ranked.agg(
        F.sum(doubled.cast("decimal(38,0)")).alias("ordered"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
    )
    pairs = F.lit(2.0) * F.col("positives") * F.col("negatives")
    return sums.select(
        F.try_divide(F.col("ordered").cast("double"), pairs).alias("auc"), "positives", "negatives"
    )


def model_auc(predictions: DataFrame, label: str = "Label", raw: str = "rawPrediction") -> DataFrame:
    """Exact area under ROC of a model's raw score, unweighted."""
    return auc(
        predictions.select(vector_to_array(raw)[1].alias("score"), F.col(label)), "score", label
    )


def evaluator_auc(predictions: DataFrame, label: str = "Label", bins: int = 1000) -> float:
    """The same from MLlib's evaluator, which thins the curve to ``bins`` points."""
    return BinaryClassificationEvaluator(labelCol=label, numBins=bins).evaluate(predictions)


def compare(runs: dict[str, DataFrame], recorded: float = fixed.RECORDED_AUC) -> DataFrame:
    """``auc`` results side by side, with their distance from a recorded one."""
    named = [
        result.select(F.lit(name).alias("run"), "auc", (F.col("auc") - F.lit(recorded)).alias("delta"))
        for name, result in runs.items()
    ]
    return reduce(DataFrame.unionByName, named)
