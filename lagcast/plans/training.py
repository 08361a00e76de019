"""Fitting a recipe: for service on all rows, in an experiment with a hold-out."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lagcast.operators import classes
from lagcast.operators.metrics import model_auc
from lagcast.operators.prepare import prepare
from lagcast.operators.split import split
from lagcast.operators.trees import fit, importances, score
from lagcast.plans.recipes import RECIPES, Recipe
from lagcast.session import scratch_path
from lagcast.sources.flights import columnar_copy
from lagcast.sources.models import save_model


def class_sizes(df: DataFrame) -> Row:
    """Rows of each class; training data of a single class is refused."""
    sizes = classes.class_counts_wide(df).first()
    if not sizes["delayed"] or not sizes["on_time"]:
        raise ValueError(
            f"training needs both classes: {sizes['delayed']} delayed, {sizes['on_time']} on time"
        )
    return sizes


def weighted(train: DataFrame, recipe: Recipe, sizes: Row) -> DataFrame:
    """The training part with the recipe's class weight, if it has one.

    The sizes are known by now, so weights are constants to all passes of a fit.
    """
    total, delayed, on_time = sizes["total"], sizes["delayed"], sizes["on_time"]
    if recipe.weighting == "ratio":
        return classes.weigh(train, F.lit(1.0), F.lit(on_time / delayed), recipe.weight_col)
    if recipe.weighting == "balanced":
        even = [F.lit(total / (2 * size)) for size in (on_time, delayed)]
        return classes.weigh(train, *even, recipe.weight_col)
    return train


def fit_recipe(train: DataFrame, recipe: Recipe, source: DataFrame | None = None, **params) -> PipelineModel:
    """Fit a recipe on prepared rows; weights come from ``source``, or from these rows."""
    sizes = class_sizes(train)
    if source is not None:
        sizes = class_sizes(source)
    return fit(
        weighted(train, recipe, sizes),
        recipe.categories,
        recipe.layout,
        recipe.estimator(**params),
        invalid=recipe.invalid,
        indicators=recipe.indicators,
    )


def _reread(rows: DataFrame, copy_path: str | None) -> DataFrame:
    """Rows that many passes will read, written once as Parquet on shared storage.

    A lost executor cannot undo the copy. Without a path it goes to the session's
    shared folder.
    """
    return columnar_copy(rows, copy_path or scratch_path(rows.sparkSession, "prepared"))


def train_for_service(
    flights: DataFrame,
    model_path: str | None = None,
    copy_path: str | None = None,
    recipe: Recipe = RECIPES["service"],
    **params,
) -> PipelineModel:
    """Prepare all rows, fit, and save the pipeline."""
    model = fit_recipe(_reread(prepare(flights, recipe.columns), copy_path), recipe, **params)
    if model_path is not None:
        save_model(model, model_path)
    return model


@dataclass(frozen=True)
class Experiment:
    """What a run with a hold-out part leaves behind.

    The tables are computed when they are read, from the run's copy of the prepared rows.
    """

    model: PipelineModel
    predictions: DataFrame
    auc: DataFrame
    importances: DataFrame
    proportions: DataFrame
    weights: DataFrame


def run_experiment(
    flights: DataFrame,
    recipe: Recipe,
    key: str | Column | None = None,
    mode: str = "hash",
    weights_from: str = "train",
    copy_path: str | None = None,
    **params,
) -> Experiment:
    """Prepare, split, profile and weigh the classes, fit, and score the hold-out.

    ``weights_from="all"`` takes class weights from all prepared rows instead
    of the training part only.
    """
    carried = (key,) if isinstance(key, str) else ()
    rows = _reread(prepare(flights, recipe.columns, carried), copy_path)
    train, test = split(rows, key, mode=mode)
    source = rows if weights_from == "all" else None
    model = fit_recipe(train, recipe, source, **params)
    predictions = score(model, test)
    return Experiment(
        model=model,
        predictions=predictions,
        auc=model_auc(predictions),
        importances=importances(model, rows),
        proportions=classes.class_proportions(train),
        weights=classes.balanced_weights(train),
    )
