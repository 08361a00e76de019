"""Boosted models where a category has many values, without boxed numbers.

MLlib's own model holds a set of boxed numbers for each node that splits a category, in the
driver and in the tasks that load it. Here the driver holds a bit for each value. On storage
the model and its pipeline have MLlib's form, written and read by tasks a few nodes at a time.
"""

import json
import os

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.param import Params
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.ml.util import DefaultParamsReader, MLWriter
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lagcast.operators.boosting import LONG_ROWS, NODE, Tree, left_bits, stored_nodes
from lagcast.session import scratch_path

MODEL = "org.apache.spark.ml.classification.GBTClassificationModel"
_TREE_MODEL = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
# A stored node's fields, the list of its split's values last, and what is sent to the driver.
_STORED = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split.featureIndex", "split.numCategories", "split.leftCategoriesOrThreshold")
_SENT = ("tree int, id int, prediction double, impurity double, stats array<double>, count long, gain double, one int, other int, "
         "feature int, values int, threshold double, bits binary")


def _metadata(spark: SparkSession, kind: str, uid: str, params: dict, defaults: dict, **more) -> str:
    said = {"class": kind, "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
    return json.dumps(said | {"paramMap": params, "defaultParamMap": defaults} | more)


def _write_metadata(spark: SparkSession, said: str, path: str) -> None:
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def _narrowed(batches):
    """Stored nodes with a threshold or, of a category, bits: what is left to send to the driver."""
    for batch in batches:
        *kept, feature, values, said = batch.columns
        one = kept[7].to_numpy()
        splits = [said[k].values.to_numpy(zero_copy_only=False) if c >= 0 else None for k, c in enumerate(one)]
        wide = [n >= 0 for n in values.to_pylist()]
        cut = [float(x[0]) if x is not None and not w else 0.0 for x, w in zip(splits, wide)]
        bits = [left_bits(x, n) if x is not None and w else None for x, w, n in zip(splits, wide, values.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*kept, feature, values, pa.array(cut, pa.float64()), pa.array(bits, pa.binary())], names=[c.split()[0] for c in _SENT.split(", ")]
        )


def read_trees(spark: SparkSession, path: str) -> list[Tree]:
    """The trees of a model that MLlib or ``WideModel`` has stored."""
    weights = {row[0]: row[2] for row in spark.read.parquet(f"{path}/treesMetadata").collect()}
    stored = spark.read.parquet(f"{path}/data").select("treeID", *[F.col(f"nodeData.{n}") for n in _STORED])
    found: dict[int, list] = {}
    for node in stored.mapInArrow(_narrowed, _SENT).toArrow().to_pylist():
        found.setdefault(node["tree"], []).append(node)
    return [Tree.of(weights[number], found[number]) for number in sorted(weights)]


class WideModel(GBTClassificationModel):
    """MLlib's boosted model with its trees as bits; MLlib's object is made where something else is asked for."""

    grown: list[Tree]
    width: int
    _whole: GBTClassificationModel | None = None
    _sent: Broadcast | None = None

    @classmethod
    def of(cls, estimator: Params, grown: list[Tree], width: int) -> "WideModel":
        """The model of trees grown as ``estimator`` says."""
        model = cls()._resetUid(estimator.uid)
        model.grown, model.width = grown, width
        estimator._copyValues(model)
        return model

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> "WideModel":
        """A stored model, read at once."""
        said = DefaultParamsReader.loadMetadata(path, spark)
        model = cls()._resetUid(said["uid"])
        model.grown, model.width = read_trees(spark, path), said["numFeatures"]
        DefaultParamsReader.getAndSetParams(model, said)
        return model

    @property
    def _java_obj(self):
        if self._whole is None:
            path = scratch_path(SparkSession.active(), "boosted-model")
            self.store(path)
            self._whole = GBTClassificationModel.load(path)
        return self._whole._java_obj

    @_java_obj.setter
    def _java_obj(self, made) -> None:
        """Nothing is made at first."""

    def __del__(self) -> None:
        """MLlib's object, if there is one, goes with the model that holds it."""

    def copy(self, extra=None) -> "WideModel":
        that = Params.copy(self, extra)
        that._whole = None
        return that

    def sent(self) -> Broadcast:
        """The trees as tasks get them, broadcast once."""
        if self._sent is None:
            self._sent = SparkSession.active().sparkContext.broadcast(self.grown)
        return self._sent

    @property
    def trees(self) -> list:
        """MLlib's trees. A plain property: listing a model's parameters looks at all else."""
        assert self._java_obj is not None
        return self._whole.trees

    @property
    def numFeatures(self) -> int:
        return self.width

    @property
    def getNumTrees(self) -> int:
        return len(self.grown)

    @property
    def treeWeights(self) -> list[float]:
        return [tree.weight for tree in self.grown]

    @property
    def featureImportances(self) -> SparseVector:
        """The gain of each feature's splits by the weight of their rows, as a share of all."""
        total = np.zeros(self.width)
        for tree in self.grown:
            inner = tree.children[:, 0] >= 0
            np.add.at(total, tree.feature[inner], (tree.gain * tree.stats[:, 0])[inner])
        if total.sum():
            total /= total.sum()
        return Vectors.sparse(self.width, [(int(k), float(total[k])) for k in np.flatnonzero(total)])

    def store(self, path: str) -> None:
        """Write the model in MLlib's form."""
        spark, sent = SparkSession.active(), self.sent()
        params, defaults = ({p.name: v for p, v in m.items()} for m in (self._paramMap, self._defaultParamMap))
        _write_metadata(spark, _metadata(spark, MODEL, self.uid, params, defaults, numFeatures=self.width, numTrees=len(self.grown)), path)
        rows = [(k, _metadata(spark, _TREE_MODEL, f"{self.uid}_{k}", {}, {}), tree.weight) for k, tree in enumerate(self.grown)]
        spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")

        def nodes(batches):
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    for some in stored_nodes(sent.value[number]):
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int32()), some], names=["treeID", "nodeData"])

        schema = spark.createDataFrame(pa.table({"treeID": pa.array([], pa.int32()), "nodeData": pa.array([], NODE)})).schema
        tasks = min(len(self.grown), int(spark.conf.get("spark.sql.shuffle.partitions")))
        numbers = spark.range(0, len(self.grown), 1, tasks)
        numbers.mapInArrow(nodes, schema).write.options(**LONG_ROWS).parquet(f"{path}/data")

    def write(self) -> MLWriter:
        return _Writer(self)


class _Writer(MLWriter):
    def __init__(self, model: WideModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        self.model.store(path)


def _places(path: str, uids: list[str]) -> list[str]:
    """Where a stored pipeline has its stages."""
    return [PipelineSharedReadWrite.getStagePath(uid, k, len(uids), os.path.join(path, "stages")) for k, uid in enumerate(uids)]


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline in MLlib's form, whatever trees it has."""
    if not isinstance(model.stages[-1], WideModel):
        model.save(path)
        return
    spark, uids = SparkSession.active(), [stage.uid for stage in model.stages]
    _write_metadata(spark, _metadata(spark, "org.apache.spark.ml.PipelineModel", model.uid, {"stageUids": uids}, {}), path)
    for stage, place in zip(model.stages, _places(path, uids)):
        stage.write().save(place)


def load_pipeline(spark: SparkSession, path: str, wide) -> PipelineModel:
    """Read a stored pipeline; ``wide`` says of the stages before boosted trees whether these are to be a ``WideModel``."""
    said = DefaultParamsReader.loadMetadata(path, spark)
    *places, last = _places(path, said["paramMap"].get("stageUids", [])) or [path]
    if not places or DefaultParamsReader.loadMetadata(last, spark)["class"] != MODEL:
        return PipelineModel.load(path)
    before = [DefaultParamsReader.loadParamsInstance(place, spark) for place in places]
    trees = WideModel.stored(spark, last) if wide(before) else GBTClassificationModel.load(last)
    return PipelineModel([*before, trees])._resetUid(said["uid"])
