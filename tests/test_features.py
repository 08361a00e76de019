import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lagcast.operators.features import assemble, index, one_hot
from lagcast.operators.vocabulary import frequency_index, vocabulary

RAISED = (PySparkException, Py4JJavaError)


@pytest.fixture()
def letters(rows):
    return rows([(v,) for v in ("b", "b", "a", "a", "c", None)], "Origin string")


def test_index_order(letters):
    fitted = index(("Origin",), "keep").fit(letters)
    assert list(fitted.labelsArray[0]) == ["a", "b", "c"]
    got = frequency_index(letters, "Origin").orderBy("index").collect()
    assert [(r.label, r["count"], r["index"]) for r in got] == [("a", 2, 0), ("b", 2, 1), ("c", 1, 2)]


def test_keep_gives_unseen_and_null_the_last_index(letters, rows):
    fitted = index(("Origin",), "keep").fit(letters)
    got = fitted.transform(rows([("z",), (None,)], "Origin string"))
    assert [r.OriginIndex for r in got.collect()] == [3.0, 3.0]


@pytest.mark.parametrize("value", ["z", None])
def test_error_raises(letters, rows, value):
    fitted = index(("Origin",)).fit(letters)
    with pytest.raises(RAISED):
        fitted.transform(rows([(value,)], "Origin string")).collect()


def test_one_hot_drops_the_last(letters):
    known = letters.dropna()
    indexed = index(("Origin",)).fit(known).transform(known)
    got = one_hot(("Origin",)).fit(indexed).transform(indexed)
    vectors = {r.Origin: list(r.v) for r in got.select("Origin", vector_to_array("OriginVec").alias("v")).collect()}
    assert vectors == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.0, 0.0]}


@pytest.mark.parametrize("value", [None, float("nan")])
def test_assembling_a_gap_raises(spark, value):
    names = assemble("L2").getInputCols()
    df = spark.createDataFrame([tuple([1.0] * (len(names) - 1) + [value])], ", ".join(f"{n} double" for n in names))
    with pytest.raises(RAISED):
        assemble("L2").transform(df).collect()


def test_vocabulary_is_sorted_and_distinct(letters):
    got = vocabulary(letters.withColumn("Dest", F.lit("x")), ("Origin", "Dest")).collect()
    assert [(r.kind, r.label) for r in got] == [("Dest", "x"), ("Origin", "a"), ("Origin", "b"), ("Origin", "c")]


def test_frequency_index_of_many_values_equals_the_indexer(spark):
    df = spark.range(20000).select(F.concat(F.lit("v"), F.pmod(F.hash("id"), F.lit(3000))).alias("Origin"))
    labels = list(index(("Origin",)).fit(df).labelsArray[0])
    assert [r.label for r in frequency_index(df, "Origin").orderBy("index").collect()] == labels


def test_frequency_index_of_a_value_that_holds_most_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("Origin"))
    got = frequency_index(df, "Origin")
    assert got.filter("index = 0").first().label == "hot"
    assert got.agg(F.count_distinct("index"), F.max("index")).first() == (3001, 3000)
