"""Train the service model: spark-submit lagcast/jobs/train.py --flights ... --model ..."""

import argparse

from pyspark.sql import SparkSession

from lagcast.plans.recipes import RECIPES
from lagcast.plans.training import train_for_service
from lagcast.sources.flights import read_flights


def run(spark: SparkSession, flights: str, model: str, copy: str | None = None, rounds: int | None = None) -> None:
    """Read all flights below a folder, whatever order their files' columns have, fit, and save the pipeline."""
    recipe = RECIPES["service"] if rounds is None else RECIPES["service"].sized(rounds)
    train_for_service(read_flights(spark, flights, by_name=True), model, copy, recipe)


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--flights", required=True, help="folder of CSV files")
    parser.add_argument("--model", required=True, help="where the fitted pipeline goes")
    parser.add_argument("--copy", help="shared folder for the prepared rows as Parquet")
    given = parser.parse_args()
    run(SparkSession.builder.appName("lagcast-train").getOrCreate(), given.flights, given.model, given.copy)
