"""Tree ensembles, their fitting and their inspection."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.operators.boosting import boost, fits
from lagcast.operators.features import assemble, index, indexer_of, one_hot
from lagcast.operators.scoring import scored, scores
from lagcast.operators.wide_model import WideModel, load_pipeline
from lagcast.session import shared_dir

# Statistics memory per pass: more nodes are split per pass over the data.
PASS_MEMORY_MB = 512

# Values of a category beyond which MLlib's boosting, whose work grows with their square, is not used.
WIDE_CATEGORY = 2_000


def rf(weight_col: str | None = "classWeight", trees: int = 40, **params) -> RandomForestClassifier:
    """A random forest on the delay label.

    MLlib keeps the node of each row in each tree beside the rows (``cacheNodeIds``):
    the trees are the same, but a level need not walk every row through every tree from its root.
    """
    forest = RandomForestClassifier(
        labelCol="Label",
        numTrees=trees,
        maxDepth=params.pop("depth", fixed.FOREST_DEPTH),
        maxBins=params.pop("bins", fixed.FOREST_BINS),
        seed=params.pop("seed", fixed.SPLIT_SEED),
        maxMemoryInMB=params.pop("maxMemoryInMB", PASS_MEMORY_MB),
        cacheNodeIds=params.pop("cacheNodeIds", True),
        **params,
    )
    return forest if weight_col is None else forest.setWeightCol(weight_col)


def gbt(weight_col: str | None = None, rounds: int = 30, **params) -> GBTClassifier:
    """Gradient-boosted trees on the delay label; a new estimator at each call."""
    boosted = GBTClassifier(
        labelCol="Label",
        maxIter=rounds,
        maxDepth=params.pop("depth", fixed.BOOSTED_DEPTH),
        maxBins=params.pop("bins", fixed.BOOSTED_BINS),
        seed=params.pop("seed", fixed.SPLIT_SEED),
        maxMemoryInMB=params.pop("maxMemoryInMB", PASS_MEMORY_MB),
        **params,
    )
    return boosted if weight_col is None else boosted.setWeightCol(weight_col)


def _widest(model: PipelineModel) -> int:
    fitted = indexer_of(model)
    extra = 1 if fitted.getHandleInvalid() == "keep" else 0
    return max(len(labels) for labels in fitted.labelsArray) + extra


def fit(df: DataFrame, categories: tuple[str, ...], layout: str, estimator, invalid: str = "keep",
        indicators: bool = False) -> PipelineModel:
    """Fit indexing, assembling and the trees, and chain them to one pipeline.

    The trees come last and by themselves, since only the fitted indexer tells
    how many bins its widest category needs: the estimator's bins are raised to
    that. They train on a view of the index without the place for unseen values,
    which no training row has: values never outnumber rows, and rows are what bins
    may not outnumber. The pipeline's own index has that place, and an unseen value
    goes where a split sends those it does not name. A null category raises.

    Several passes are made over ``df``, so callers hold or store it; the
    trees themselves keep their binned form of it between rounds. Boosting with a
    category of more than ``WIDE_CATEGORY`` values grows the same trees by ``boosting``.
    """
    shared_dir(df.sparkSession)  # where boosting cuts its growing lineage
    stages = [index(categories, invalid).fit(df)]
    seen = stages[0] if indicators else stages[0].copy().setHandleInvalid("error")
    current = seen.transform(df)
    if indicators:
        stages.append(one_hot(categories).fit(current))
        current = stages[-1].transform(current)
    stages.append(assemble(layout))
    current = stages[-1].transform(current)

    if not indicators:
        widest = _widest(PipelineModel(stages))
        estimator = estimator.copy({estimator.maxBins: max(estimator.getMaxBins(), widest)})

    weight = [estimator.getWeightCol()] if estimator.isDefined("weightCol") else []
    assembled = current.select("features", "Label", *weight)
    wide = not indicators and widest > WIDE_CATEGORY and fits(estimator)
    stages.append(WideModel.of(estimator, *boost(assembled, estimator, _category_sizes(stages[0], layout))) if wide else estimator.fit(assembled))
    return PipelineModel(stages)


def _category_sizes(indexer: StringIndexerModel, layout: str) -> dict[int, int]:
    """How many values the category at each place of a layout has."""
    sizes = dict(zip(indexer.getInputCols(), map(len, indexer.labelsArray)))
    indexed = {f"{c}Index": n for c, n in sizes.items()}
    return {k: indexed[c] for k, c in enumerate(fixed.LAYOUTS[layout]) if c in indexed}


def _wide(before: list) -> bool:
    """Whether boosted trees after these fitted stages have a category of more than ``WIDE_CATEGORY`` values."""
    return not any(isinstance(s, OneHotEncoderModel) for s in before) and _widest(PipelineModel(before)) > WIDE_CATEGORY


def load(spark: SparkSession, path: str) -> PipelineModel:
    """A stored pipeline; boosted trees with wide categories are read as bits."""
    return load_pipeline(spark, path, _wide)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """A table with raw score, class probabilities and predicted class added.

    Boosted trees with a category of more than ``WIDE_CATEGORY`` values are walked by ``scoring``.
    """
    *before, trees = model.stages
    if not scores(trees) or not _wide(before):
        return model.transform(df)
    return scored(trees, PipelineModel(before).transform(df))


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the vector's positions, from its attributes; reads no rows and needs no trees."""
    attributes = PipelineModel(model.stages[:-1]).transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    named = [(a["idx"], a["name"]) for group in attributes.values() for a in group]
    return [name for _, name in sorted(named)]


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Importance of each feature of the fitted trees, by position and name.

    ``df`` is any table the model can score; only its schema is used.
    """
    spark: SparkSession = df.sparkSession
    values = model.stages[-1].featureImportances.toArray()
    rows = [
        (position, name, float(values[position]))
        for position, name in enumerate(feature_names(model, df))
    ]
    return spark.createDataFrame(rows, "position int, name string, importance double")
