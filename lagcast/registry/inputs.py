"""Inputs of the registered queries, all derived from the test tables by Spark."""

from functools import cache

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.functions.once import with_computed
from lagcast.operators.prepare import prepare
from lagcast.operators.split import split
from lagcast.plans.recipes import RECIPES
from lagcast.plans.training import Experiment, run_experiment, train_for_service
from lagcast.schemas import RAW_REQUEST, REQUEST
from lagcast.sources.fixture import flights

KEY = "event_id"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepared(spark: SparkSession, folder: str, version: str = "V3") -> DataFrame:
    return prepare(flights(spark, folder), version, (KEY,))


def training(spark: SparkSession, folder: str) -> DataFrame:
    """The training part of the prepared flights."""
    return split(prepared(spark, folder), KEY)[0]


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A second imbalanced set with another schema."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("double").alias("Label"))
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.join(documents, "doc_id")


def tenth(hour: str = "Hour") -> Column:
    """A score 0.0, 0.1 ... 1.0 from the hour, which hits every band's cuts exactly."""
    return (F.col(hour) % 11).cast("double") / 10.0


def wire_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per flight in wire form, some of them faulty by their id."""
    m = F.col(KEY) % 10
    rows = flights(spark, folder).na.fill(0.0, ["Wind_Gust", "Ice_Accretion_3hr"])
    values = {
        "request_id": F.concat(F.lit("r"), F.col(KEY)),
        "Month": F.when(m == 1, "x").when(m == 5, "5.7").otherwise(F.month("Time").cast("string")),
        "Hour": F.when(m != 2, F.hour("Time").cast("string")),
        "Temperature": F.when(m == 3, "nan").otherwise(F.col("Temperature").cast("string")),
    }
    return rows.select(
        KEY, F.col("Time").cast("timestamp").alias("timestamp"),
        *[values.get(n, F.col(n).cast("string")).alias(n) for n in RAW_REQUEST.names],
    )


def request_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The wire requests as messages: numbers quoted or bare, and some cut short."""
    m = F.col(KEY) % 10
    quoted = F.to_json(F.struct(*RAW_REQUEST.names))
    bare = F.to_json(
        F.struct(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in REQUEST])
    )
    value = F.when(m == 0, F.substring(quoted, 1, 40)).when(m < 6, quoted).otherwise(bare)
    return wire_requests(spark, folder).select("timestamp", value.alias("value"))


def lacking_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Wire requests that leave fields out, each field where a part of the id says so."""
    m = F.col(KEY) % 7
    absent = {"Carrier": 0, "Origin": 1, "Dest": 2, "Month": 3, "Temperature": 4, "Wind_Speed": 5}
    rows = wire_requests(spark, folder)
    return rows.withColumns(
        {c: F.when(m != at, F.col(c)) for c, at in absent.items()}
    ).select(*RAW_REQUEST.names)


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """One timed request per event; a third share one id, and a few have none."""
    return table(spark, folder, "events").select(_request_id().alias("request_id"), F.col("ts").alias("req_ts"))


def _request_id() -> Column:
    own = F.concat(F.lit("r"), F.col(KEY))
    return F.when(F.col(KEY) % 3 == 0, F.lit("hot")).when(F.col(KEY) % 50 != 1, own)


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to most events: 3, 10 or 20 seconds later, a third of them sent twice, some too early too."""
    k = F.col("k")
    parsed = {"k": F.get_json_object("props", "$.k").cast("int")}
    events = with_computed(table(spark, folder, "events"), parsed, KEY, "ts")
    wait = F.when(k % 10 < 6, 3).when(k % 10 < 8, 20).when(k % 10 == 8, 10)
    first = events.filter(wait.isNotNull()).select(
        _request_id().alias("request_id"), "k", "ts", wait.alias("wait")
    )
    again = F.when(k % 3 == 0, F.array(F.col("wait") + 1, F.lit(-3))).otherwise(F.array().cast("array<int>"))
    sent = F.concat(F.array("wait"), again)
    timed = first.withColumn("wait", F.explode(sent))
    return timed.select(
        "request_id",
        (F.col("ts") + F.make_dt_interval(secs=F.col("wait"))).alias("resp_ts"),
        (k / 100.0).alias("probability"),
        F.when(k > 50, "High").otherwise("Low").alias("risk"),
    )


@cache
def _experiment(application: str, spark: SparkSession, folder: str, recipe: str) -> Experiment:
    return run_experiment(flights(spark, folder), RECIPES[recipe], key=KEY)


def experiment(spark: SparkSession, folder: str, recipe: str) -> Experiment:
    """An experiment, fitted once per session and folder."""
    return _experiment(spark.sparkContext.applicationId, spark, folder, recipe)


@cache
def _model(application: str, spark: SparkSession, folder: str) -> PipelineModel:
    return train_for_service(flights(spark, folder))


def service_model(spark: SparkSession, folder: str) -> PipelineModel:
    """The service's model, fitted on all flights once per session and folder."""
    return _model(spark.sparkContext.applicationId, spark, folder)
