"""Vocabularies on storage: one JSON object, or a row per label, as the writer says."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.fixed import VOCABULARY_FIELDS
from lagcast.schemas import VOCABULARY
from lagcast.sources.storage import publish, published

_ROWS = "kind string, label string"


def write_vocab(labels: DataFrame, path: str, form: str = "object") -> None:
    """Write ``(kind, label)`` rows.

    They replace what is there without a gap. ``object`` is one object of sorted lists, written by one task; ``rows`` are sorted
    rows, written by all tasks, for vocabularies of any size. Readers take both.
    """
    if form == "rows":
        written = labels.orderBy("kind", "label")
    elif form == "object":
        written = vocabulary_object(labels)
    else:
        raise ValueError(f"unknown form {form!r}")
    publish(labels.sparkSession, path, written.write.json)


def vocabulary_object(labels: DataFrame) -> DataFrame:
    """One row with a sorted list per category; an absent category is empty."""
    return labels.agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("label")))).alias(field)
            for field, kind in VOCABULARY_FIELDS.items()
        ]
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """The stored vocabulary as one object; three empty lists where nothing is stored.

    Only a missing path counts as nothing; any other failure to read is an error.
    """
    if published(spark, path) is None:
        return spark.createDataFrame([([], [], [])], VOCABULARY)
    return vocabulary_object(read_labels(spark, path))


def _labelled(field: str, kind: str) -> Column:
    present = F.coalesce(F.col(field), F.array().cast("array<string>"))
    return F.transform(
        present, lambda label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    )


def _labelled_lists() -> Column:
    """The lists of an object as one array of (kind, label); absent lists are empty."""
    lists = [_labelled(field, kind) for field, kind in VOCABULARY_FIELDS.items()]
    return F.flatten(F.array(*lists))


def vocabulary_labels(vocabulary: DataFrame) -> DataFrame:
    """``(kind, label)`` rows of a vocabulary object."""
    return vocabulary.select(F.inline(_labelled_lists()))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Stored vocabularies as ``(kind, label)`` rows, whichever form they have."""
    either = ", ".join([f"{f} array<string>" for f in VOCABULARY_FIELDS] + [_ROWS])
    stored = spark.read.schema(either).json(published(spark, path) or path)
    single = F.array(F.struct("kind", "label"))
    return stored.select(F.inline(F.when(F.col("kind").isNull(), _labelled_lists()).otherwise(single)))
