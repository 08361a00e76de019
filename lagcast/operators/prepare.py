"""Cleaning and labelling. All steps are narrow: one scan, no shuffle."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagcast import fixed


def select_features(df: DataFrame, version: str = "V3", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a set, after any others the caller wants carried along."""
    return df.select(*keep, *fixed.COLUMN_SETS[version])


def fill_weather(df: DataFrame, columns: tuple[str, ...] = fixed.FILLED_COLUMNS) -> DataFrame:
    """Missing gusts and icing mean there were none: null and NaN become 0.0."""
    return df.na.fill(0.0, list(columns))


def _complete(field: T.StructField) -> Column:
    present = F.col(f"`{field.name}`").isNotNull()
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return present & ~F.isnan(f"`{field.name}`")
    return present


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without null or NaN.

    Said column by column, so that the null tests reach the Parquet scan.
    """
    return df.filter(reduce(lambda a, b: a & b, [_complete(f) for f in df.schema]))


def with_label(
    df: DataFrame, threshold: float = fixed.DELAY_THRESHOLD_MINUTES, delay: str = "DepDelayMinutes"
) -> DataFrame:
    """``Label`` 1.0 where the delay exceeds the threshold, 0.0 elsewhere."""
    late = F.col(delay) > F.lit(threshold)
    return df.withColumn("Label", F.when(late, 1.0).otherwise(0.0))


def with_time_parts(df: DataFrame, time: str = "Time") -> DataFrame:
    """Month and hour of the departure time."""
    return df.withColumns({"Month": F.month(time), "Hour": F.hour(time)})


def filter_class(df: DataFrame, value: float, label: str = "Label") -> DataFrame:
    """Rows of one class."""
    return df.filter(F.col(label) == F.lit(float(value)))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """The same value in every row."""
    return df.withColumn(name, F.lit(value))


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """Some ``n`` rows, for a look at a table."""
    return df.limit(n)


def prepare(df: DataFrame, version: str = "V3", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flight records ready for training.

    The order counts: filling first saves the rows whose only gaps are filled
    ones, and only gaps in the selected columns cost a row.
    """
    chosen = select_features(df, version, keep)
    return with_time_parts(with_label(drop_incomplete(fill_weather(chosen))))
