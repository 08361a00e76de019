"""Reading flight records, and keeping a columnar copy of them."""

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagcast.schemas import FLIGHT_TYPES


def _declared(names: list[str]) -> T.StructType:
    """Known columns with their declared types, any others as text."""
    return T.StructType(
        [T.StructField(n, FLIGHT_TYPES.get(n, T.StringType())) for n in names]
    )


def files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The CSV files below ``path``, those with one header line together; empty files are left out.

    Tasks look at the first line of each file; a line for each file is shuffled, and the
    driver gets the files' names, as it does to read them. Lines are read, not parsed.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    starts = lines.where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
    placed = starts.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    headers = placed.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    grouped = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted([_as_path(file) for file in row.files] for row in grouped.select("files").collect())


def _as_path(uri: str) -> str:
    """A file's address as a path to read, with nothing that stands for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


# Types of a column by name that hold all values of the ones before them.
_WIDER = ("int", "bigint", "double", "string")


def _common(one: T.DataType, other: T.DataType) -> T.DataType:
    """A type for the values of both."""
    names = {one.simpleString(), other.simpleString()}
    if len(names) == 1:
        return one
    if names == {"date", "timestamp"}:
        return T.TimestampType()
    widest = max((_WIDER.index(n) if n in _WIDER else len(_WIDER) - 1) for n in names)
    return {"bigint": T.LongType(), "double": T.DoubleType()}.get(_WIDER[widest], T.StringType())


def _by_name(spark: SparkSession, reader, path: str, infer: bool) -> DataFrame:
    """Files with different headers as one table, joined by the columns' names."""
    groups = files_by_header(spark, path) or [[path]]
    if infer:
        schemas = [reader.option("inferSchema", "true").csv(files).schema for files in groups]
        types: dict[str, T.DataType] = {}
        for field in (f for schema in schemas for f in schema):
            types[field.name] = _common(types.get(field.name, field.dataType), field.dataType)
        schemas = [T.StructType([T.StructField(f.name, types[f.name]) for f in schema]) for schema in schemas]
    else:
        schemas = [_declared(reader.csv(files[0]).columns) for files in groups]
    checked = reader.option("inferSchema", "false").option("enforceSchema", "false")
    parts = [checked.schema(schema).csv(files) for schema, files in zip(schemas, groups)]
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)


def read_flights(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    infer: bool = False,
    timestamp_format: str | None = None,
    by_name: bool = False,
) -> DataFrame:
    """Every CSV file below ``path``, each with a header row.

    CSV columns are matched by position. A file whose header differs from the
    schema therefore fails the job instead of having its columns swapped
    silently; with ``by_name`` files are grouped by their headers, each group is
    read under its own, and columns come together by name, null where a file has
    none. That takes a pass over the lines. Without a schema the column names come
    from a header and the types from the contract, so no pass over the data is spent
    on inference; ``infer=True`` asks for that pass, always by name: a column gets a
    type for all files. Times may have any ISO form unless a format is given.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("header", "true")
    if timestamp_format is not None:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    if schema is None and (infer or by_name):
        return _by_name(spark, reader, path, infer)
    if schema is None:
        schema = _declared(reader.csv(path).columns)
    return reader.option("enforceSchema", "false").schema(schema).csv(path)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: its name, type and whether it may be null."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def columnar_copy(df: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back, for jobs that scan it often.

    The rows are dealt evenly to ``files`` files, by default as many as the session
    has shuffle partitions, so that every pass is as parallel as a shuffle, however
    few files the source has.
    """
    count = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(count).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
