import pytest
from pyspark.sql import functions as F

from lagcast.operators import classes
from lagcast.operators.split import split
from lagcast.plans.training import class_sizes


@pytest.fixture()
def labels(rows):
    return lambda *values: rows([(v,) for v in values], "Label double")


def test_profile(labels):
    df = labels(1.0, 0.0, 0.0, 0.0)
    wide = classes.class_counts_wide(df).first()
    assert (wide.total, wide.delayed, wide.on_time) == (4, 1, 3)
    assert classes.balance_ratio(df).first().ratio == 3.0
    assert {r.Label: r.Proportion for r in classes.class_proportions(df).collect()} == {1.0: 0.25, 0.0: 0.75}
    weights = {r.Label: r.class_weight for r in classes.balanced_weights(df).collect()}
    assert weights == {0.0: 4 / 6, 1.0: 2.0}


@pytest.mark.parametrize("values", [(), (0.0, 0.0), (1.0,)])
def test_missing_class(labels, values):
    df = labels(*values)
    ratio = classes.balance_ratio(df).first().ratio
    assert ratio == (0.0 if 1.0 in values else None)
    weights = {r.Label: r.class_weight for r in classes.balanced_weights(df).collect()}
    assert set(weights) == {0.0, 1.0} and None in weights.values()
    with pytest.raises(ValueError, match="both classes"):
        class_sizes(df)


def test_weights_even_out_the_classes(labels):
    df = labels(*[1.0] * 3, *[0.0] * 12)
    sums = classes.with_balanced_weight(df).groupBy("Label").agg(F.sum("class_weight")).collect()
    assert sums[0][1] == pytest.approx(sums[1][1]) == pytest.approx(7.5)
    ratio = classes.with_ratio_weight(df).groupBy("Label").agg(F.sum("classWeight")).collect()
    assert ratio[0][1] == pytest.approx(ratio[1][1])


def test_weights_can_come_from_another_part(labels):
    df, source = labels(1.0, 0.0), labels(1.0, 0.0, 0.0, 0.0, 0.0)
    got = classes.with_ratio_weight(df, source).filter("Label = 1.0").first()
    assert got.classWeight == 4.0


@pytest.fixture()
def numbered(spark):
    return spark.range(5000).withColumn("v", F.col("id") % 10)


def test_split_is_disjoint_complete_and_stable(numbered):
    train, test = split(numbered, "id")
    assert train.count() + test.count() == 5000
    assert train.join(test, "id").count() == 0
    assert abs(train.count() / 5000 - 0.8) < 0.03
    other, _ = split(numbered.repartition(13), "id")
    assert other.exceptAll(train).count() == 0


def test_split_without_key_keeps_copies_together(numbered):
    doubled = numbered.union(numbered)
    train, test = split(doubled)
    assert train.join(test, "id").count() == 0
    assert train.groupBy("id").count().filter("count <> 2").count() == 0


def test_split_tells_null_from_text(rows):
    df = rows([(None, "a"), ("~", "a"), ("a", None), ("", "=a")], "x string, y string")
    train, test = split(df)
    assert train.count() + test.count() == 4


def test_random_split_is_complete(numbered):
    train, test = split(numbered, mode="random")
    assert train.count() + test.count() == 5000
    assert train.join(test, "id").count() == 0


def test_null_key_is_in_one_part(rows):
    train, test = split(rows([(None,), ("a",)], "k string"), "k")
    assert train.count() + test.count() == 2


@pytest.mark.parametrize("ratio", [0.0, 1.0, 0.805])
def test_split_refuses_ratios_it_cannot_make(numbered, ratio):
    with pytest.raises(ValueError):
        split(numbered, "id", ratio)


def test_split_needs_no_shuffle(numbered):
    assert "Exchange" not in split(numbered, "id")[0]._jdf.queryExecution().toString()
