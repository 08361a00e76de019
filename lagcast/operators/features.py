"""Categories to indices, indicators and one feature vector."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame

from lagcast import fixed


def index(cols: tuple[str, ...], invalid: str = "error") -> StringIndexer:
    """Indices by falling frequency, all columns fitted in one pass.

    ``error`` raises at an unseen or null value, ``keep`` gives it the index
    after the last.
    """
    return StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}Index" for c in cols], handleInvalid=invalid
    )


def one_hot(cols: tuple[str, ...]) -> OneHotEncoder:
    """Indicator vectors of indexed columns; the last category has none."""
    return OneHotEncoder(
        inputCols=[f"{c}Index" for c in cols], outputCols=[f"{c}Vec" for c in cols]
    )


def assemble(layout: str, output: str = "features") -> VectorAssembler:
    """A layout's columns as one vector; a missing value raises."""
    return VectorAssembler(
        inputCols=list(fixed.LAYOUTS[layout]), outputCol=output, handleInvalid="error"
    )


def indexer_of(model: PipelineModel) -> StringIndexerModel:
    """The fitted indexer of a pipeline."""
    return next(s for s in model.stages if isinstance(s, StringIndexerModel))


def inputs_of(model: PipelineModel) -> list[str]:
    """Columns a pipeline's feature vector is made of."""
    return next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()


def labels_of(model: PipelineModel) -> dict[str, list[str]]:
    """Labels per indexed column, in index order."""
    fitted = indexer_of(model)
    columns = fitted.getInputCols() if fitted.isSet("inputCols") else [fitted.getInputCol()]
    return dict(zip(columns, (list(labels) for labels in fitted.labelsArray)))


def model_vocabulary(model: PipelineModel, like: DataFrame) -> DataFrame:
    """The fitted labels as ``(kind, label)`` rows sorted A to Z.

    Fitting has brought the labels to the driver already, so none are read again.
    """
    rows = [(kind, label) for kind, labels in labels_of(model).items() for label in sorted(labels)]
    return like.sparkSession.createDataFrame(rows, "kind string, label string")
