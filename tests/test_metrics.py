import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagcast.operators import metrics
from lagcast.operators.ordering import preceding_totals


def by_pairs(pairs):
    positive = [s for s, y in pairs if y == 1.0]
    negative = [s for s, y in pairs if y == 0.0]
    won = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return won / (len(positive) * len(negative))


@pytest.mark.parametrize("distinct", [1, 2, 7, 1000])
def test_auc_equals_counting_all_pairs(rows, distinct):
    draw = random.Random(distinct)
    pairs = [(float(draw.randrange(distinct)), float(draw.random() < 0.3)) for _ in range(400)]
    got = metrics.auc(rows(pairs, "score double, Label double")).first()
    assert got.auc == pytest.approx(by_pairs(pairs), abs=1e-12)
    assert got.positives + got.negatives == 400


def test_auc_with_one_hot_score(rows):
    pairs = [(0.5, float(i % 2)) for i in range(300)] + [(float(i), float(i % 3 == 0)) for i in range(60)]
    assert metrics.auc(rows(pairs, "score double, Label double")).first().auc == pytest.approx(by_pairs(pairs))


@pytest.mark.parametrize("pairs", [[], [(0.1, 1.0)], [(0.1, 0.0), (0.2, 0.0)]])
def test_auc_needs_both_classes(rows, pairs):
    assert metrics.auc(rows(pairs, "score double, Label double")).first().auc is None


def test_auc_does_not_overflow(spark):
    # 4e9 x 4e9 pairs do not fit 64 bits once doubled; counts stand in for rows here.
    counts = spark.createDataFrame(
        [(0.1, 0, 4 * 10**9), (0.9, 4 * 10**9, 0)], "score double, positives long, negatives long"
    )
    original = metrics.score_counts
    metrics.score_counts = lambda df, score, label: df
    try:
        assert metrics.auc(counts).first().auc == 1.0
    finally:
        metrics.score_counts = original


def test_auc_equals_the_evaluator(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(3000).select(
        (F.rand(1) < 0.3).cast("double").alias("Label"), F.round(F.rand(2), 3).alias("s")
    ).withColumn("s", F.col("s") + F.col("Label") * 0.2)
    df = df.withColumn("rawPrediction", array_to_vector(F.array(-F.col("s"), F.col("s")))).checkpoint()
    assert metrics.model_auc(df).first().auc == pytest.approx(metrics.evaluator_auc(df, bins=0), abs=1e-9)


@pytest.fixture(params=[("8", "true"), ("64", "true"), ("64", "false")], ids=str)
def shuffle(spark, request):
    """Partitions and adaptive execution, which may merge them."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, request.param):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_preceding_totals_over_many_partitions(spark, shuffle):
    df = spark.range(10000).select(F.pmod(F.hash("id"), F.lit(2)).alias("g"), "id", F.lit(1).alias("one"))
    got = preceding_totals(df.repartition(16), [F.asc("id")], {"rank": "one"}, within=("g",))
    wrong = got.join(
        got.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("d")), "g"
    ).filter("n <> d or top <> n - 1")
    assert wrong.count() == 0
    lag = F.lag("rank").over(Window.partitionBy("g").orderBy("id"))
    assert got.withColumn("before", lag).filter("rank <> before + 1").count() == 0


def test_only_partition_sums_meet_in_one_task(spark):
    rows = spark.range(1000).select(
        F.col("id").cast("double").alias("score"), (F.col("id") % 2).cast("double").alias("Label")
    )
    plan = metrics.auc(rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 2
    # Below each is an aggregate: the final sums, or one row per partition.
    assert all("HashAggregate" in lines[i + 1] for i in single)


def test_compare(rows):
    run = metrics.auc(rows([(0.1, 0.0), (0.9, 1.0)], "score double, Label double"))
    got = metrics.compare({"a": run, "b": run}, recorded=0.7).collect()
    assert [(r.run, r.auc, round(r.delta, 9)) for r in got] == [("a", 1.0, 0.3), ("b", 1.0, 0.3)]
