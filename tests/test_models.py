import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from lagcast.fixed import LAYOUTS
from lagcast.functions.risk import delay_probability, risk_band
from lagcast.operators.features import labels_of, model_vocabulary
from lagcast.operators import boosting, trees
from lagcast.operators.prepare import prepare
from lagcast.operators.trees import gbt, importances, rf, score
from lagcast.operators.vocabulary import vocabulary
from lagcast.plans.predicting import predict
from lagcast.plans.recipes import RECIPES
from lagcast.plans.training import fit_recipe, run_experiment, train_for_service
from lagcast.sources.fixture import flights
from lagcast.sources.models import load_model, save_model
from lagcast.sources.requests import requests_df
from lagcast.sources.storage import published
from test_requests import GOOD

KEY = "event_id"


@pytest.fixture(scope="module")
def table(spark, folder):
    return flights(spark, folder).cache()


@pytest.fixture(scope="module")
def service(table):
    return train_for_service(table, recipe=RECIPES["service"].sized(2))


@pytest.fixture(scope="module")
def strict(table):
    return run_experiment(table, RECIPES["carrier"].sized(2), key=KEY, depth=4)


def test_estimators_carry_the_fixed_parameters():
    forest, boosted = rf(trees=50), gbt()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins()) == (50, 10, 64)
    assert forest.getWeightCol() == "classWeight"
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getMaxBins()) == (30, 5, 500)
    assert not boosted.isSet("weightCol")
    assert gbt("class_weight").getWeightCol() == "class_weight" and not gbt().isSet("weightCol")


def test_forests_keep_the_nodes_of_rows_and_grow_the_same_trees(table):
    rows = prepare(table, "V2")
    kept, walked = (fit_recipe(rows, RECIPES["carrier"].sized(3), depth=5, **more).stages[-1] for more in ({}, {"cacheNodeIds": False}))
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    one, two = (m.toDebugString.splitlines()[1:] for m in (kept, walked))
    assert len(one) > 50 and one == two


def test_recipes():
    assert RECIPES["baseline"].estimator().getNumTrees() == 40
    assert RECIPES["service"].estimator().getMaxIter() == 20
    assert RECIPES["route"].estimator().getMaxIter() == 30
    assert RECIPES["balanced"].estimator().getWeightCol() == "class_weight"
    assert RECIPES["route"].weight_col is None


def test_experiment_leaves_everything(strict, table):
    assert 0.0 <= strict.auc.first().auc <= 1.0
    total = strict.importances.agg(F.sum("importance"), F.min("importance")).first()
    assert total[0] == pytest.approx(1.0) and total[1] >= 0.0
    assert strict.predictions.count() + strict.proportions.agg(F.sum("count")).first()[0] == prepare(table, "V2").count()
    assert {r.Label for r in strict.weights.collect()} == {0.0, 1.0}


def test_one_hot_importances_have_names(table):
    done = run_experiment(table, RECIPES["baseline"].sized(2), key=KEY, depth=3, weights_from="all")
    names = [r.name for r in done.importances.orderBy("position").collect()]
    assert names[-8:] == ["Month", "Hour", "Temperature", "Wind_Speed", "Wind_Gust",
                          "Precipitation", "Visibility", "Ice_Accretion_3hr"]
    assert all(n.startswith("OriginVec_") for n in names[:-8]) and len(names) == 12


def test_probabilities_and_bands(service, table):
    scored = score(service, prepare(table)).select(delay_probability().alias("p"), "prediction")
    wrong = scored.filter(
        ~F.col("p").between(0, 1) | (risk_band(F.col("p")) != F.when(F.col("prediction") == 1.0, "High").otherwise("Low"))
    )
    assert wrong.count() == 0


def test_bins_follow_the_widest_category(table):
    wide = prepare(table.withColumn("Dest", F.concat(F.lit("D"), F.col(KEY) % 700)))
    model = fit_recipe(wide, RECIPES["service"].sized(1))
    assert len(labels_of(model)["Dest"]) > 500
    assert model.stages[-1].getOrDefault("maxBins") == len(labels_of(model)["Dest"]) + 1


def test_category_of_many_values_trains(spark):
    rows = spark.range(12_000).select(
        F.concat(F.lit("D"), "id").alias("Dest"), F.concat(F.lit("O"), F.col("id") % 3).alias("Origin"),
        F.lit("C").alias("Carrier"), *[F.lit(1.0).alias(c) for c in LAYOUTS["L3"][3:]],
        (F.col("id") % 2).cast("double").alias("Label"),
    )
    model = fit_recipe(rows, RECIPES["service"].sized(1), depth=1)
    assert len(labels_of(model)["Dest"]) == 12_000
    assert model.stages[-1].getOrDefault("maxBins") == 12_001


@pytest.mark.parametrize("recipe, rounds, depth", [("route", 4, 5), ("balanced", 3, 4)])
def test_wide_categories_grow_mllib_s_trees(spark, monkeypatch, recipe, rounds, depth):
    rng, columns = random.Random(5), ("Origin", "Dest", "Carrier", *LAYOUTS["L3"][3:])
    data = []  # no two features alike, so no two splits are equally good
    for k in range(8_000):
        dest, numbers = rng.randint(0, 40), [float(rng.randint(0, 15)) for _ in LAYOUTS["L3"][3:]]
        odds = (dest * 7 % 13) / 26 + numbers[1] / 60 + numbers[3] * numbers[0] / 900
        data.append((k, f"O{rng.randint(0, 3)}", f"D{dest}", f"C{rng.randint(0, 8)}", *numbers, float(rng.random() < odds)))
    rows = spark.createDataFrame(data, ("k", *columns, "Label")).repartition(5).cache()
    models = [fit_recipe(rows, RECIPES[recipe].sized(rounds), depth=depth)]
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    models.append(fit_recipe(rows, RECIPES[recipe].sized(rounds), depth=depth))
    one, two = (m.stages[-1] for m in models)
    told = [[line for line in m.toDebugString.splitlines() if "feature" in line] for m in (one, two)]
    assert len(told[0]) > 50 and told[0][1:] == told[1][1:]
    assert two.featureImportances.toArray() == pytest.approx(one.featureImportances.toArray(), abs=1e-9)
    assert {p.name: v for p, v in two.extractParamMap().items()} == {p.name: v for p, v in one.extractParamMap().items()}
    p, q = (score(m, rows).select("k", delay_probability().alias(c)) for m, c in zip(models, "pq"))
    apart = p.join(q, "k").agg(F.count(F.lit(1)), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert apart[0] == 8_000 and apart[1] < 1e-9


def _wide_rows(spark, n):
    rng = random.Random(7)
    data = [
        (k, f"O{k % 3}", f"D{rng.randint(0, 60)}", f"C{k % 5}", *[float(rng.randint(0, 9)) for _ in LAYOUTS["L3"][3:]], float(rng.random() < 0.2 + k % 3 / 5))
        for k in range(n)
    ]
    return spark.createDataFrame(data, ("k", "Origin", "Dest", "Carrier", *LAYOUTS["L3"][3:], "Label")).repartition(3).cache()


def test_wide_models_score_without_trees_in_the_code_of_tasks(spark, monkeypatch, tmp_path):
    rows = _wide_rows(spark, 4_000)
    model = fit_recipe(rows, RECIPES["route"].sized(4))
    asked = rows.withColumn("Dest", F.when(F.col("k") % 5 == 0, "elsewhere").otherwise(F.col("Dest")))
    names = ("rawPrediction", "probability", "prediction")
    old = score(model, asked)
    assert score(model, asked).schema == model.transform(asked).schema
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    model.save(str(tmp_path / "m"))
    for wide in (model, load_model(str(tmp_path / "m"))):
        new = score(wide, asked)
        assert "margin" in new._jdf.queryExecution().toString() and "margin" not in old._jdf.queryExecution().toString()
        assert [(f.name, f.dataType, f.metadata) for f in new.schema] == [(f.name, f.dataType, f.metadata) for f in old.schema]
        one, two = ({r.k: r for r in df.select("k", *names).collect()} for df in (old, new))
        assert len(two) == 4_000 and all(two[k].prediction == one[k].prediction for k in one)
        for k in one:
            assert list(two[k].rawPrediction) == pytest.approx(list(one[k].rawPrediction), abs=1e-12)
            assert list(two[k].probability) == pytest.approx(list(one[k].probability), abs=1e-12)


def test_cells_of_features_that_tasks_share_are_added_up(spark, monkeypatch):
    rows = _wide_rows(spark, 3_000)
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    one = fit_recipe(rows, RECIPES["balanced"].sized(2), depth=3).stages[-1]
    monkeypatch.setattr(boosting, "NARROW", 1)
    monkeypatch.setattr(boosting, "CHUNK", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    two = fit_recipe(rows, RECIPES["balanced"].sized(2), depth=3).stages[-1]
    told = [[line for line in m.toDebugString.splitlines() if "feature" in line] for m in (one, two)]
    assert len(told[0]) > 10 and told[0][1:] == told[1][1:]


def test_a_task_sends_few_rows_of_cells(spark, tmp_path):
    def block(batches):
        bins = [np.arange(1_000, dtype=k) for k in (np.uint16, np.uint16)]
        yield from boosting._packed([boosting._bytes(bins, np.ones(1_000, np.int8), np.zeros(0), np.zeros(1_000))])

    rows = spark.range(1, numPartitions=1).mapInArrow(block, boosting.BLOCK)
    got = boosting._histogram(rows, boosting.Walk({}), [0], [1_000, 1_000], True, 0).collect()
    assert len(got) == 2 and all(len(r.bins) == 4_000 and len(r.cells) == 32_000 for r in got)


def test_trees_are_written_many_at_a_time(monkeypatch):
    monkeypatch.setattr(boosting, "STORED_VALUES", 10)
    made = [[{"id": i, "split": {"leftCategoriesOrThreshold": [0.0] * n}} for i in range(3)] for n in (1, 2, 1, 5, 0, 3)]
    runs = list(boosting._runs(made))
    assert [sorted({k for k, _ in run}) for run in runs] == [[0, 1], [2], [3], [4, 5]]
    assert [pair for run in runs for pair in run] == [(k, node) for k, nodes in enumerate(made) for node in nodes]


def test_wide_models_need_no_boxed_numbers(spark, monkeypatch, tmp_path):
    rows = _wide_rows(spark, 3_000)
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    monkeypatch.setattr(boosting, "STORED_VALUES", 20)  # several batches a tree
    model = fit_recipe(rows, RECIPES["balanced"].sized(3), depth=4)
    importances(model, rows).collect()
    score(model, rows).collect()
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    for one in (model, again):
        assert score(one, rows).select("prediction").distinct().count() == 2
        assert one.stages[-1]._whole is None  # MLlib's own model was not made
    plain = PipelineModel.load(published(spark, str(tmp_path / "m")))  # MLlib reads what is stored
    assert type(plain.stages[-1]) is GBTClassificationModel and plain.uid == again.uid == model.uid
    mine = again.stages[-1]
    assert mine.featureImportances.toArray() == pytest.approx(plain.stages[-1].featureImportances.toArray(), abs=1e-12)
    assert (mine.treeWeights, mine.getNumTrees, mine.numFeatures) == (plain.stages[-1].treeWeights, 3, 10)
    assert mine.toDebugString == plain.stages[-1].toDebugString == model.stages[-1].toDebugString
    p, q = (df.select("k", delay_probability().alias("p")) for df in (score(again, rows), plain.transform(rows)))
    assert p.join(q.withColumnRenamed("p", "q"), "k").where(F.abs(F.col("p") - F.col("q")) < 1e-12).count() == 3_000


def test_blocks_of_rows_lie_in_small_groups_and_parts(spark, monkeypatch, tmp_path):
    def blocks(batches):
        rng = np.random.default_rng(1)
        yield from boosting._packed([[rng.bytes(3 << 20), b"", b"", b""] for _ in range(20)])

    rows, path = boosting._written(spark.range(1, numPartitions=1).mapInArrow(blocks, boosting.BLOCK))
    (file,) = Path(path.removeprefix("file:")).glob("*.parquet")
    stored = pq.ParquetFile(file).metadata
    assert rows.count() == 20 and max(stored.row_group(k).num_rows for k in range(stored.num_row_groups)) < 10

    def batches_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with boosting._small_batches(spark):
        assert rows.mapInArrow(batches_of, "n long").agg(F.max("n")).first()[0] < 32 << 20
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    parts = []
    monkeypatch.setattr(boosting, "_clustered", lambda *a, dealt=boosting._clustered: parts.append(a[-1]) or dealt(*a))
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    fit_recipe(_wide_rows(spark, 3_000), RECIPES["route"].sized(1), depth=1)
    assert parts == [12]  # 250 rows each, more than the session's shuffle partitions


def test_many_values_are_cut_like_mllib_does(spark, monkeypatch):
    rng = random.Random(6)
    data = [
        (f"O{k % 3}", f"D{k % 40}", "C", *[rng.gauss(0, 1) for _ in LAYOUTS["L3"][3:]], float(rng.random() < 0.2 + (k % 40) / 80))
        for k in range(3_000)
    ]
    rows = spark.createDataFrame(data, ("Origin", "Dest", "Carrier", *LAYOUTS["L3"][3:], "Label")).cache()
    one = fit_recipe(rows, RECIPES["route"].sized(2), depth=3, bins=64).stages[-1]
    monkeypatch.setattr(trees, "WIDE_CATEGORY", 2)
    two = fit_recipe(rows, RECIPES["route"].sized(2), depth=3, bins=64).stages[-1]
    told = [[line for line in m.toDebugString.splitlines() if "feature" in line] for m in (one, two)]
    assert told[0][1:] == told[1][1:]


def test_saved_model_scores_the_same(table, tmp_path):
    path, copy = str(tmp_path / "m"), str(tmp_path / "copy")
    model = train_for_service(table, path, copy, RECIPES["service"].sized(1))
    train_for_service(table, path, None, RECIPES["service"].sized(1))  # replaces
    rows = prepare(table, keep=(KEY,))
    one, two = (score(m, rows).select(KEY, delay_probability().alias("p")) for m in (model, load_model(path)))
    assert one.exceptAll(two).count() == 0


def test_model_vocabulary_equals_the_table_s(service, table):
    mine = model_vocabulary(service, table).collect()
    assert sorted(map(tuple, mine)) == sorted(map(tuple, vocabulary(prepare(table)).collect()))


def test_single_class_is_refused(table):
    with pytest.raises(ValueError, match="both classes"):
        fit_recipe(prepare(table).filter("Label = 0.0"), RECIPES["service"].sized(1))


def test_predict_with_keep_scores_unknown_categories(service, spark):
    asked = [GOOD, {**GOOD, "request_id": "x", "Hour": "late"}]
    got = {r.request_id: r for r in predict(service, requests_df(spark, asked), "extreme").collect()}
    assert got["r"].error is None and 0 <= got["r"].probability <= 1 and "O -> D linią C" in got["r"].verdict
    assert got["x"].probability is None and got["x"].verdict == "Błąd: bad Hour"


def test_predict_with_strict_model_names_unknown_categories(strict, spark):
    known = {**GOOD, "Origin": "click", "Carrier": "C1", "Dest": None}
    asked = [known, {**known, "request_id": "u", "Origin": "moon"}, {**known, "request_id": "n", "Carrier": None}]
    got = {r.request_id: r for r in predict(strict.model, requests_df(spark, asked), "three").collect()}
    assert got["r"].error is None and got["r"].verdict.startswith("Ryzyko opóźnienia: ")
    assert got["u"].error == "unknown Origin" and got["n"].error == "missing Carrier"


def test_predict_uses_visibility_where_the_model_does(table, spark):
    model = run_experiment(table, RECIPES["baseline"].sized(2), key=KEY, depth=3).model
    asked = requests_df(spark, [{**GOOD, "Origin": "click"}])
    fine = predict(model, asked.withColumn("Visibility", F.lit("9")), "alert").first()
    assert fine.error is None and ("LOT PLANOWY" in fine.verdict or "RYZYKO" in fine.verdict)
    assert predict(model, asked.withColumn("Visibility", F.lit("far")), "alert").first().error == "bad Visibility"
    assert predict(model, asked, "alert").first().error == "missing Visibility"


def test_weights_change_what_is_predicted(table):
    late = [
        run_experiment(table, RECIPES[r].sized(3), key=KEY).predictions.agg(F.avg("prediction")).first()[0]
        for r in ("route", "balanced")
    ]
    assert late[1] > late[0]


def test_importances_without_rows(service, table):
    got = importances(service, prepare(table).limit(0))
    assert [r.name for r in got.orderBy("position").collect()][:3] == ["OriginIndex", "DestIndex", "CarrierIndex"]
