"""A flights table derived from the generic ``events`` table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.functions.once import with_computed


def flights_from_events(events: DataFrame) -> DataFrame:
    """Events as flight records, row for row, with ``event_id`` kept as row key."""
    k = F.col("k")
    parsed = F.get_json_object("props", "$.k").cast("int")
    days = (F.lit(30) * (F.col("user_id") % 12)).cast("int")
    return with_computed(events, {"k": parsed}, "event_id", "ts", "user_id", "event_type", "value").select(
        "event_id",
        (F.col("value") / 10.0 + F.hour("ts") * F.lit(0.5)).alias("DepDelayMinutes"),
        (F.col("ts") + F.make_dt_interval(days)).alias("Time"),
        F.col("event_type").alias("Origin"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("Dest"),
        F.concat(F.lit("C"), (k % 17).cast("string")).alias("Carrier"),
        F.when(k != 13, k.cast("double")).alias("Temperature"),
        ((k * 7) % 41).cast("double").alias("Wind_Speed"),
        ((k % 5).cast("double") / 10.0).alias("Precipitation"),
        (k % 11).cast("double").alias("Visibility"),
        F.when(k % 4 != 0, k.cast("double") / 2.0).alias("Wind_Gust"),
        F.when(k % 10 == 0, k.cast("double") / 50.0).alias("Ice_Accretion_3hr"),
    )


def flights(spark: SparkSession, folder: str) -> DataFrame:
    """The flights table of a test-data folder."""
    return flights_from_events(spark.read.parquet(f"{folder}/events.parquet"))
