"""Scores of boosted trees where a category has many values.

MLlib sends a model's trees with the code of every task, each set of categories as boxed
numbers. Here the trees are broadcast once, a bit for each value of a category, and batches
of rows walk them together. Columns, their metadata and their values are MLlib's, the margin
up to the order in which the trees' predictions are added.
"""

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.operators.wide_model import WideModel, read_trees
from lagcast.session import scratch_path

# What MLlib says of the columns of two classes.
_OF_CLASSES = {"ml_attr": {"num_attrs": 2}}
_OF_CLASS = {"ml_attr": {"num_vals": 2, "type": "nominal"}}


def scores(model) -> bool:
    """Whether a model asks for nothing but what is done here."""
    return isinstance(model, GBTClassificationModel) and not model.isDefined("thresholds") and not model.getLeafCol()


def _sent(spark: SparkSession, model: GBTClassificationModel) -> Broadcast:
    """The trees of a model, broadcast once; those of MLlib's own are read from the form in which it stores them."""
    if isinstance(model, WideModel):
        return model.sent()
    if not hasattr(model, "walked"):
        path = scratch_path(spark, "scored-model")
        model.save(path)
        model.walked = spark.sparkContext.broadcast(read_trees(spark, path))
    return model.walked


def _margin(spark: SparkSession, model: GBTClassificationModel) -> Column:
    """The margin of a row's features."""
    walked = _sent(spark, model)

    @F.arrow_udf("double")
    def margin(x: pa.Array) -> pa.Array:
        rows = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T)
        total = np.zeros(len(x))
        for tree in walked.value:
            tree.add(rows, total)
        return pa.array(total)

    return margin(vector_to_array(model.getFeaturesCol()))


def scored(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """What ``model.transform`` adds to an assembled table: raw score, class probabilities and predicted class."""
    m = F.col("_margin")
    on_time = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(2.0) * m))
    added = {
        model.getRawPredictionCol(): (array_to_vector(F.array(-m, m)), _OF_CLASSES),
        model.getProbabilityCol(): (array_to_vector(F.array(on_time, F.lit(1.0) - on_time)), _OF_CLASSES),
        model.getPredictionCol(): (F.when(m > 0.0, 1.0).otherwise(0.0), _OF_CLASS),
    }
    with_margin = df.withColumn("_margin", _margin(df.sparkSession, model))
    return with_margin.select(*df.columns, *[c.alias(n, metadata=said) for n, (c, said) in added.items()])
