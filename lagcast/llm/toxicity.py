"""Toxicity by subword embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, all hashed. The embeddings of a
bag are averaged and go into a softmax over the two classes; a text's odds are the
logarithm of the mean of its words' odds, so few words among many are seen and the
softmax needs labels of whole texts only. Embeddings and softmax are trained together
by gradient steps on those. A misspelt or unseen word shares n-gram vectors with known
ones. A logistic regression on labelled texts kept back turns the pooled odds, the
highest odds of a word and the length into a probability.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lagcast.llm.arrays import U64, Spans, Texts, add_columns, mix
from lagcast.llm.folds import chunks, smallest
from lagcast.llm.logistic import Logistic, sigmoid

BITS = 18  # of hashed features
DIM = 8
ORDERS = (3, 4, 5)  # bytes of n-grams
LEAST = 5  # a feature of fewer chunks has no vector

# Bounds of what is learned from, of each class: labelled documents, chunks that train.
SAMPLE_DOCS = 4000
SAMPLE_CHUNKS = 4000
SAMPLE_CHUNK = 4096
CALIBRATION_ROWS = 6000

EPOCHS = 4
BATCH = 64
RATE = 0.2
RIDGE = 1e-5  # of the calibration: the classes lie far apart


class Words:
    """The distinct words of texts, the word of each token, and the features of each word."""

    def __init__(self, texts: Texts):
        starts, ends, self.first = texts.words()
        self.spans = Spans(texts.data, lower=True)
        self.hashes, at, self.token = np.unique(self.spans.hashes(starts, ends), return_index=True, return_inverse=True)
        self.starts, self.ends = starts[at], ends[at]

    def features(self):
        """Word numbers and buckets: the words themselves, then the n-grams of each order."""
        yield np.arange(len(self.hashes)), (self.hashes >> U64(64 - BITS)).astype(np.int64)
        sizes = self.ends - self.starts
        for order in ORDERS:
            made = np.maximum(sizes - order + 1, 0)
            word = np.repeat(np.arange(len(made)), made)
            start = np.arange(len(word)) + np.repeat(self.starts - np.cumsum(made) + made, made)
            yield word, (mix(self.spans.hashes(start, start + order) + U64(order)) >> U64(64 - BITS)).astype(np.int64)


class ToxicityModel:
    """The odds that each feature adds to its words', and a calibration: a bounded number of bytes."""

    def __init__(self, prior: float):
        self.prior = prior
        self.odds = np.zeros(1 << BITS, dtype=np.float32)
        self.bias = 0.0
        self.calibration: Logistic | None = None

    def columns(self, texts: Texts) -> np.ndarray:
        """Pooled odds, highest odds of a word, and length of each text; zeros without a word."""
        out = np.zeros((len(texts), 3))
        words = Words(texts)
        n = np.diff(words.first)
        some = np.flatnonzero(n)
        if len(some):
            total, size = np.zeros(len(words.hashes)), np.zeros(len(words.hashes))
            for word, bucket in words.features():
                total += np.bincount(word, self.odds[bucket], minlength=len(total))
                size += np.bincount(word, minlength=len(total))
            odds = (total / size + self.bias)[words.token]
            pooled, highest = pool(odds, words.first[:-1][some], n[some])
            out[some] = np.column_stack([pooled, highest, np.log2(n[some] + 1)])
        return out

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of being toxic; the prior for texts without a word."""
        found = np.full(len(texts), self.prior)
        if self.calibration is not None:
            columns = self.columns(texts)
            some = columns[:, 2] > 0
            if some.any():
                found[some] = self.calibration.predict(columns[some])
        return np.round(found, 12)  # equal texts have equal scores, whatever their block


def pool(odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the mean of the exponentials in each run, and its highest value."""
    highest = np.maximum.reduceat(odds, starts)
    total = np.add.reduceat(np.exp(odds - np.repeat(highest, sizes)), starts)
    return np.log(total / sizes) + highest, highest


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Sample:
    """Chunks to train on: how often each has each word, and the features of every word."""

    def __init__(self, samples: list[bytes]):
        hashes, buckets, sizes, chunk, word, times = [], [], [], [], [], []
        known, low = 0, 0
        joined = Texts(np.frombuffer(b"".join(samples), np.uint8), np.cumsum([0, *map(len, samples)]).astype(np.int64))
        for low, _, block in joined.blocks():
            words = Words(block)
            pairs = [np.concatenate(p) for p in zip(*words.features())]
            order = np.argsort(pairs[0], kind="stable")
            buckets.append(pairs[1][order].astype(np.int32))
            sizes.append(np.bincount(pairs[0], minlength=len(words.hashes)))
            hashes.append(words.hashes)
            n = max(len(words.hashes), 1)
            owner = np.repeat(np.arange(len(block)), np.diff(words.first))
            met, count = np.unique(owner * n + words.token, return_counts=True)
            chunk.append(met // n + low)
            word.append(met % n + known)
            times.append(count)
            known += len(words.hashes)
        hashes, buckets, sizes = map(np.concatenate, (hashes, buckets, sizes))
        _, at, same = np.unique(hashes, return_index=True, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        self.buckets, self.sizes = buckets[_runs(starts[at], sizes[at])], sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bounds = np.searchsorted(np.concatenate(chunk), np.arange(len(samples) + 1))
        self.word, self.times = same[np.concatenate(word)], np.concatenate(times)

    def chunks_with(self) -> np.ndarray:
        """In how many chunks each bucket occurs, words with several equal ones counted so often."""
        chunks = np.bincount(self.word, minlength=len(self.sizes))
        return np.bincount(self.buckets, np.repeat(chunks, self.sizes), minlength=1 << BITS)


def train(model: ToxicityModel, samples: list[bytes], labels: np.ndarray) -> None:
    """Embeddings and softmax by steps of a size per feature; both classes weigh the same."""
    rng = np.random.default_rng(1)
    sample = Sample(samples)
    known = sample.chunks_with() >= LEAST
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    vectors[~known] = 0
    softmax = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    slopes, softmax_slopes = np.full(1 << BITS, 1e-10, dtype=np.float32), np.full((DIM, 2), 1e-4, dtype=np.float32)
    share = 0.5 / np.array([1 - labels.mean(), labels.mean()])
    filled = np.flatnonzero(np.diff(sample.bounds))
    for _ in range(EPOCHS):
        order = rng.permutation(filled)
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            label = labels[some]
            sizes = np.diff(sample.bounds)[some]
            at = _runs(sample.bounds[some], sizes)
            chunk, times = np.repeat(np.arange(len(some)), sizes), sample.times[at]
            words, word = np.unique(sample.word[at], return_inverse=True)
            made = sample.sizes[words]
            bucket, owner = sample.buckets[_runs(sample.starts[words], made)], np.repeat(np.arange(len(words)), made)
            averaged = np.add.reduceat(vectors[bucket], np.cumsum(made) - made, axis=0) / made[:, None]
            logits = averaged @ softmax + bias
            odds = (logits[:, 1] - logits[:, 0])[word]
            starts = np.cumsum(sizes) - sizes
            highest = np.maximum.reduceat(odds, starts)
            raised = times * np.exp(odds - highest[chunk])
            total = np.add.reduceat(raised, starts)
            toxic = sigmoid(np.log(total / np.add.reduceat(times, starts)) + highest)
            error = (toxic - label) * share[label] / len(some)
            of_word = np.bincount(word, error[chunk] * raised / total[chunk], minlength=len(words))
            errors = np.column_stack([-of_word, of_word]).astype(np.float32)

            back = (errors @ softmax.T) / made[:, None]
            by = np.argsort(bucket, kind="stable")
            ordered = bucket[by]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            slope, place = np.add.reduceat(back[owner[by]], first, axis=0), ordered[first]
            slope[~known[place]] = 0
            slopes[place] += np.einsum("ij,ij->i", slope, slope) / DIM
            vectors[place] -= RATE * slope / np.sqrt(slopes[place])[:, None]
            slope = averaged.T @ errors
            softmax_slopes += slope * slope
            softmax -= RATE * slope / np.sqrt(softmax_slopes)
            bias -= RATE * errors.sum(axis=0)
    model.odds = vectors @ (softmax[:, 1] - softmax[:, 0])
    model.bias = float(bias[1] - bias[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label") -> ToxicityModel:
    """Learns from the documents of ``docs`` that ``labels`` marks 1 (toxic) or 0.

    Keys labelled both ways, null keys and other labels are left out. At most
    ``SAMPLE_DOCS`` keys of each class are taken, those with the smallest hashes, and
    joined to the documents as a broadcast of at most twice so many keys. Four fifths of
    them train, by at most ``SAMPLE_CHUNKS`` chunks of each class; the others, whole,
    calibrate, weighted by how many keys of their class each stands for. Without
    labelled text of both classes every score is the share of toxic labels, or 0.5.
    """
    clear = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(label).cast("int").alias("__label"), F.max(label).cast("int").alias("__most"))
        .where("__label = __most")
        .select("__key", "__label", F.xxhash64(F.col("__key").cast("string"), F.lit("toxicity")).alias("__rank"))
    )
    counts = {r[0]: r[1] for r in clear.groupBy("__label").count().collect()}
    model = ToxicityModel(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    parts = [smallest(clear.where(F.col("__label") == k), SAMPLE_DOCS, F.col("__rank"), F.col("__key")) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # bounded by 2 * SAMPLE_DOCS rows
    named = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    labelled = named.join(F.broadcast(chosen), "__key").select("__label", "__rank", "text").where(F.length("text") > 0)
    kept_back = F.pmod(F.col("__rank"), F.lit(5)) == 0

    cut = chunks(labelled.where(~kept_back), "__label", "__rank", "text", (SAMPLE_CHUNK,))
    by_class = [smallest(cut.where(F.col("label") == k), SAMPLE_CHUNKS, F.col("rank"), F.col("chunk")).collect() for k in (0, 1)]
    if not all(by_class):
        return model
    samples = [bytes(r.chunk) for rows in by_class for r in rows]
    train(model, samples, np.repeat([0, 1], [len(rows) for rows in by_class]))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            for low, high, block in Texts.of(batch.column(2)).blocks():
                columns = pa.array(list(shared.value.columns(block)), type=pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], batch.column(1)[low:high], columns], names=["label", "rank", "columns"]
                )

    measured = labelled.where(kept_back).mapInArrow(measure, "label int, rank long, columns array<double>")
    rows = smallest(measured, CALIBRATION_ROWS, F.xxhash64("rank", F.lit(1)), F.col("columns")).collect()
    truth = np.array([r[0] for r in rows], dtype=int)
    if len(set(truth.tolist())) == 2:
        stands_for = np.array([max(counts[k] / SAMPLE_DOCS, 1.0) for k in (0, 1)])
        model.calibration = Logistic(np.array([r[2] for r in rows]), truth.astype(float), ridge=RIDGE, weights=stands_for[truth])
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from the threshold on).

    Whole texts are scored, each row by its own text. Null texts and texts without a
    word get the share of toxic labels. Columns of ``df`` named score or predicted are
    replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> dict:
        texts = Texts.of(batch.column(batch.schema.get_field_index(text)))
        found = [shared.value.scores(block) for _, _, block in texts.blocks()]
        return {"score": np.concatenate(found) if found else np.zeros(0)}

    scored = add_columns(df, StructType([StructField("score", DoubleType())]), judge, keep=keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
