"""Delay risk by time, operator, route and weather."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _risk(df: DataFrame, *groups: str | Column) -> DataFrame:
    delayed = F.count_if(F.col("Label") == 1.0)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("flights"),
        delayed.alias("delayed"),
        (delayed / F.count(F.lit(1))).alias("risk"),
    )


def risk_by_time(df: DataFrame) -> DataFrame:
    """Share of delayed flights per month and hour."""
    return _risk(df, "Month", "Hour")


def risk_by_carrier(df: DataFrame) -> DataFrame:
    """Share of delayed flights per carrier."""
    return _risk(df, "Carrier")


def risk_by_route(df: DataFrame) -> DataFrame:
    """Share of delayed flights per origin and destination."""
    return _risk(df, "Origin", "Dest")


def risk_by_gust(df: DataFrame, step: int = 10) -> DataFrame:
    """Share of delayed flights per band of gust speed, named by its lower end."""
    lower = (F.floor(F.col("Wind_Gust") / F.lit(step)) * step).alias("gust_from")
    return _risk(df, lower)


def risk_by_icing(df: DataFrame) -> DataFrame:
    """Share of delayed flights with and without icing."""
    return _risk(df, (F.col("Ice_Accretion_3hr") > 0.0).alias("icing"))
