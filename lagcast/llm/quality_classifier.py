"""Quality by compression: which of two dictionaries shortens a text more.

One zstandard dictionary is built from text labelled good, one from text labelled
bad. A text is compressed in fixed chunks with either; the difference of the sizes,
normalised by the text's length and by the compressed size, says which kind it is
like. A logistic regression on labelled documents that are in neither dictionary
turns the difference, the mean ratio and the length into a probability.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lagcast.llm.arrays import Texts, add_columns
from lagcast.llm.components import arrow_rows
from lagcast.llm.folds import chunks, smallest
from lagcast.llm.logistic import Logistic

# Bounds of what is learned from: labelled documents of each class, chunks of each
# class that a dictionary is built from, rows that calibrate.
SAMPLE_DOCS = 8000
SAMPLE_CHUNKS = 6000
SAMPLE_CHUNK = 2048
CALIBRATION_ROWS = 6000

BATCH_ROWS = 1000  # labelled texts that a task holds at once
DICTIONARY = 112_640
CHUNK = 512
LEVEL = 3


class CompressionModel:
    """Two dictionaries and a calibration; small enough to travel with each task."""

    def __init__(self, good: bytes | None, bad: bytes | None, prior: float):
        self.good, self.bad, self.prior = good, bad, prior
        self.calibration: Logistic | None = None

    @property
    def complete(self) -> bool:
        return bool(self.good) and bool(self.bad)

    def compressors(self):
        """A compressor with each dictionary."""
        made = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_dict_id=False)
            )
        return made

    def columns(self, texts: Texts) -> np.ndarray:
        """What calibration looks at, for each text."""
        good, bad = (c.compress for c in self.compressors())
        sizes = np.diff(texts.offsets).astype(float)
        with_good, with_bad = np.zeros(len(texts)), np.zeros(len(texts))
        for k in np.flatnonzero(sizes):
            text = texts.bytes_of(k)
            chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
            with_good[k] = sum(len(good(c)) for c in chunks)
            with_bad[k] = sum(len(bad(c)) for c in chunks)
        size = np.maximum(sizes, 1)
        length = np.log2(size + 1)
        of_sum = (with_bad - with_good) / np.maximum(with_bad + with_good, 1)
        of_size = (with_bad - with_good) / size
        ratio = (with_bad + with_good) / (2 * size)
        return np.column_stack([of_sum, of_size, ratio, length, of_sum * length, of_size * length, ratio * length])

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of being good; the prior for empty texts."""
        found = np.full(len(texts), self.prior)
        if self.calibration is not None:
            some = np.diff(texts.offsets) > 0
            if some.any():
                found[some] = self.calibration.predict(self.columns(texts)[some])
        return found


def _dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary of the samples' common passages; of few samples, their text."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=200, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label") -> CompressionModel:
    """Learns from the documents of ``docs`` that ``labels`` marks 1 (good) or 0 (bad).

    At most ``SAMPLE_DOCS`` labelled keys of each class are taken, those with the
    smallest hashes, and joined to the documents as a broadcast of at most twice so
    many keys; the texts are not shuffled. Keys labelled both ways, null keys and
    null labels are left out. Three fifths of the keys give chunks for the
    dictionaries, the others calibrate, weighted by how many keys of their class each
    stands for, so that the bound does not change the share of good ones. Without a label of both classes every score
    is the share of good ones, or 0.5.
    """
    clear = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(label).alias("__label"), F.max(label).alias("__most"))
        .where(F.col("__label") == F.col("__most"))
        .select("__key", F.col("__label").cast("int"), F.xxhash64(F.col("__key").cast("string")).alias("__rank"))
    )
    counts = {r[0]: r[1] for r in clear.groupBy("__label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    parts = [smallest(clear.where(F.col("__label") == k), SAMPLE_DOCS, F.col("__rank"), F.col("__key")) for k in (0, 1)]
    stands_for = np.array([max(counts.get(k, 0) / SAMPLE_DOCS, 1.0) for k in (0, 1)])
    chosen = parts[0].unionByName(parts[1])  # bounded by 2 * SAMPLE_DOCS rows
    labelled = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")
    labelled = labelled.select("__label", "__rank", "text").where(F.length("text") > 0)
    calibrates = F.pmod(F.col("__rank"), F.lit(5)) >= 3

    chunked = chunks(labelled.where(~calibrates), "__label", "__rank", "text", (SAMPLE_CHUNK,))
    bad, good = (
        [bytes(r.chunk) for r in smallest(chunked.where(F.col("label") == k), SAMPLE_CHUNKS, F.col("rank"), F.col("chunk")).collect()]
        for k in (0, 1)
    )
    model = CompressionModel(_dictionary(good), _dictionary(bad), prior)
    if not model.complete:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(list(shared.value.columns(Texts.of(batch.column(2)))), type=pa.list_(pa.float64())),
                ],
                names=["__label", "rank", "columns"],
            )

    measured = labelled.where(calibrates).mapInArrow(measure, "__label int, rank long, columns array<double>")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows = smallest(measured, CALIBRATION_ROWS, F.xxhash64("rank", F.lit(1)), F.col("columns")).collect()
    truth = np.array([r[0] for r in rows], dtype=float)
    if len(set(truth.tolist())) == 2:
        model.calibration = Logistic(np.array([r[2] for r in rows]), truth, weights=stands_for[truth.astype(int)])
    return model


def score_quality(df: DataFrame, model: CompressionModel, *, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1 from the threshold on).

    Whole texts are scored. Empty and null texts get the share of good labels.
    Columns of ``df`` named score or predicted are replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> dict:
        texts = Texts.of(batch.column(batch.schema.get_field_index(text)))
        return {"score": shared.value.scores(texts)}

    scored = add_columns(df, StructType([StructField("score", DoubleType())]), judge, keep=keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
