"""Class profile and class weights.

Every figure comes out of one aggregation with partial sums, so a class that
holds nearly all rows costs nothing extra.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as ``rows``."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def class_counts_wide(df: DataFrame, label: str = "Label") -> DataFrame:
    """One row: ``total``, ``delayed`` and ``on_time`` rows."""
    of = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(of == 1.0).alias("delayed"),
        F.count_if(of == 0.0).alias("on_time"),
    )


def class_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).count()


def class_proportions(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per class and their share of all rows, from a single scan."""
    counts = class_counts(df, label).agg(
        F.sum("count").alias("total"),
        # One entry per class, not per row.
        F.collect_list(F.struct(label, "count")).alias("classes"),
    )
    return counts.select("total", F.inline("classes")).select(
        label, "count", (F.col("count") / F.col("total")).alias("Proportion")
    )


def balance_ratio(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows on time per delayed row; null where no row is delayed."""
    return class_counts_wide(df, label).withColumn("ratio", _ratio())


def balanced_weights(df: DataFrame, label: str = "Label") -> DataFrame:
    """Both classes with their count and the weight that evens them out."""
    wide = class_counts_wide(df, label)
    pairs = F.array(
        *[
            F.struct(
                F.lit(value).alias(label),
                F.col(name).alias("count"),
                _evening(F.col(name)).alias("class_weight"),
            )
            for value, name in ((0.0, "on_time"), (1.0, "delayed"))
        ]
    )
    return wide.select(F.inline(pairs))


def _ratio() -> Column:
    return F.try_divide(F.col("on_time").cast("double"), F.col("delayed"))


def _evening(count: Column) -> Column:
    return F.try_divide(F.col("total").cast("double"), F.lit(2) * count)


def weigh(df: DataFrame, on_time: Column, delayed: Column, name: str, label: str = "Label") -> DataFrame:
    """Rows with the weight of their class; what is not on time weighs as delayed."""
    return df.withColumn(name, F.when(F.col(label) == 0.0, on_time).otherwise(delayed))


def with_ratio_weight(
    df: DataFrame, source: DataFrame | None = None, label: str = "Label", name: str = "classWeight"
) -> DataFrame:
    """Delayed rows weigh the imbalance ratio of ``source``, all others 1.0.

    ``source`` is the part the ratio is taken from, ``df`` itself by default.
    The ratio enters as a scalar subquery: no join, nothing on the driver.
    """
    ratio = balance_ratio(source if source is not None else df, label).select("ratio").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1.0, ratio).otherwise(1.0))


def with_balanced_weight(
    df: DataFrame, source: DataFrame | None = None, label: str = "Label", name: str = "class_weight"
) -> DataFrame:
    """Each row weighs what evens out its class in ``source``."""
    wide = class_counts_wide(source if source is not None else df, label)
    weights = wide.select(
        F.struct(
            _evening(F.col("on_time")).alias("on_time"), _evening(F.col("delayed")).alias("delayed")
        ).alias("weights")
    ).scalar()
    return weigh(df, weights.getField("on_time"), weights.getField("delayed"), name, label)
