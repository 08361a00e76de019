"""Vocabularies of categorical columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.operators.ordering import preceding_totals


def _labels(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """All columns' values as ``(kind, label)`` rows, from one scan; nulls left out."""
    pairs = [
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("label")) for c in cols
    ]
    return df.select(F.inline(F.array(*pairs))).filter(F.col("label").isNotNull())


def vocabulary(df: DataFrame, cols: tuple[str, ...] = ("Origin", "Dest", "Carrier")) -> DataFrame:
    """The distinct values of each column as sorted ``(kind, label)`` rows.

    Values meet their own kind before the shuffle, so only distinct ones of each
    task travel.
    """
    return _labels(df, cols).distinct().orderBy("kind", "label")


def frequency_index(df: DataFrame, *cols: str) -> DataFrame:
    """Values of each column numbered by falling frequency, ties A to Z.

    These are the numbers that indexing assigns. Columns: ``kind``, ``label``,
    ``count``, ``index``.
    """
    counts = _labels(df, cols).groupBy("kind", "label").count().withColumn("one", F.lit(1))
    ranked = preceding_totals(
        counts, [F.desc("count"), F.asc("label")], {"index": "one"}, within=("kind",)
    )
    return ranked.select("kind", "label", "count", "index")
