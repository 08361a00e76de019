"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit predicts it
from hashed byte n-grams; the language whose codeword has the least logistic loss
under all predictions, each bit weighted by how well its classifier does on chunks
kept back, is chosen. A text is ambiguous if the second codeword is nearly as near.

Chunks of the sampled texts are dealt to shards by hash. A task trains on one shard,
which has chunks of all languages, and the classifiers of the shards are averaged.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lagcast.llm.arrays import LOWER, Texts, add_columns
from lagcast.llm.components import passing_tables, stored
from lagcast.llm.folds import chunks, smallest
from lagcast.llm.logistic import sigmoid

BUCKETS = 8192
ORDERS = (2, 3, 4)
ROWS = 256  # texts turned into one dense matrix
BITS = 15

# Bounds of what is learned from, of each language: documents, and chunks of them.
SAMPLE_DOCS = 2000
SAMPLE_CHUNKS = 4000
CHUNK_SIZES = (1024, 64, 256)
SHARD_CHUNKS = 1 << 14  # about as many chunks in a shard

EPOCHS = 6
RATE = 4.0
UNKNOWN = "und"


def codewords(languages: int, bits: int = BITS, draws: int = 200) -> np.ndarray:
    """Codewords of -1 and 1, far apart from each other; no bit is the same for all."""
    bits = max(bits, int(np.ceil(4 * np.log2(max(languages, 2)))))
    rng = np.random.default_rng(languages)
    best, most = None, -1
    for _ in range(draws):
        code = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        flat = np.abs(code.sum(axis=0)) == languages
        code[0, flat] *= -1 if languages > 1 else 1
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + bits * np.eye(languages, dtype=int)
        if apart.min() > most:
            best, most = code, apart.min()
    return best.astype(np.float32)


def ngram_matrix(texts: Texts) -> np.ndarray:
    """Square roots of the counts of hashed byte n-grams, each row of length one."""
    data, offsets, n = LOWER[texts.data].astype(np.uint32), texts.offsets, len(texts)
    text = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    counts = np.zeros(n * BUCKETS, dtype=np.float32)
    joined = data * np.uint32(0x9E3779B1)
    for order in range(2, max(ORDERS) + 1):
        if len(joined) < 2:
            break
        joined = (joined[:-1] ^ (joined[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + data[order - 1 :] * np.uint32(0xC2B2AE35)
        if order in ORDERS:
            whole = left[: len(joined)] >= order
            bucket = (joined ^ (joined >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 13)
            counts += np.bincount((text[: len(joined)] + bucket)[whole], minlength=n * BUCKETS)
    matrix = np.sqrt(counts, out=counts).reshape(n, BUCKETS)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    matrix /= np.maximum(length, 1e-9)[:, None]
    return matrix


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text has a letter of any script."""
    lower = LOWER[texts.data]
    found = texts.counts((lower >= 97) & (lower <= 122)) > 0
    wide = texts.counts(texts.data >= 128) > 0
    for k in np.flatnonzero(wide & ~found):
        found[k] = any(c.isalpha() for c in bytes(texts.bytes_of(k)).decode("utf-8", "ignore"))
    return found


class LanguageModel:
    """Codewords, one linear classifier per bit, and the weights of the bits."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, BITS), np.float32)
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), dtype=np.float32)
        self.bias = np.zeros(bits, dtype=np.float32)
        self.trust = np.ones(bits, dtype=np.float32)

    def average(self, shards: list) -> None:
        """Takes the mean of the classifiers of the shards, weighted by their chunks."""
        total = sum(s.chunks for s in shards)
        for name in ("weights", "bias", "trust"):
            mean = np.zeros(getattr(self, name).size)
            for s in sorted(shards, key=lambda s: s.shard):
                mean += np.frombuffer(s[name], "<f4") * (s.chunks / total)
            setattr(self, name, mean.astype(np.float32).reshape(getattr(self, name).shape))

    def train(self, samples: list[bytes], labels: np.ndarray) -> None:
        """Steps of mini-batches; every language weighs the same, a tenth is kept back."""
        rng = np.random.default_rng(7)
        self.weights[:], self.bias[:] = 0, 0
        share = 1.0 / np.bincount(labels, minlength=len(self.languages))[labels]
        share = (share / share.mean()).astype(np.float32)
        order = rng.permutation(len(samples))
        back, used = order[: len(order) // 10], order[len(order) // 10 :]
        slopes = np.full_like(self.weights, 1e-6)
        for _ in range(EPOCHS):
            for k in range(0, len(used), ROWS):
                some = used[k : k + ROWS]
                x, want = ngram_matrix(_texts([samples[i] for i in some])), self.code[labels[some]]
                error = -want * sigmoid(-want * self._margins(x)) * share[some, None] / len(some)
                slope = x.T @ error
                slopes += slope * slope
                self.weights -= RATE * 0.05 * slope / np.sqrt(slopes)
                self.bias -= RATE * 0.05 * error.sum(axis=0)
            rng.shuffle(used)
        if len(back):
            margins = np.concatenate(
                [self._margins(ngram_matrix(_texts([samples[i] for i in back[k : k + ROWS]]))) for k in range(0, len(back), ROWS)]
            )
            right = ((margins > 0) == (self.code[labels[back]] > 0)).mean(axis=0)
            self.trust = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)

    def _margins(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ self.weights + self.bias

    def decode(self, matrix: np.ndarray) -> np.ndarray:
        """Probability-like weights of the languages, by the loss of their codewords."""
        margins = self._margins(matrix)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) @ self.trust
        loss -= loss.min(axis=1, keepdims=True)
        odds = np.exp(-loss)
        return odds / odds.sum(axis=1, keepdims=True)


def _texts(samples: list[bytes]) -> Texts:
    return Texts(np.frombuffer(b"".join(samples), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in samples])]).astype(np.int64))


def fit_languages(docs: DataFrame, *, text: str = "text", lang: str = "lang", rank: str = "doc_id") -> LanguageModel:
    """Learns from the texts of ``docs`` with a language.

    Every language is learned, from about ``SAMPLE_DOCS`` documents, chosen by a hash of
    ``rank``, and at most ``SAMPLE_CHUNKS`` chunks of these; null texts and languages are
    left out. Shards of chunks are as many as the chunks ask for, whatever the cluster;
    only their classifiers reach the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    counted = known.groupBy(F.col(lang).alias("lang")).count().collect()
    model = LanguageModel(sorted(r["lang"] for r in counted))
    if not model.languages:
        return model
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, SAMPLE_DOCS / r["count"]))])
    spot = F.xxhash64(F.col(rank).cast("string"))
    ranked = known.select(F.col(lang).alias("lang"), spot.alias("rank"), F.col(text).alias("text"))
    drawn = ranked.where(F.pmod(F.col("rank"), F.lit(1 << 20)) < shares[F.col("lang")] * F.lit(1 << 20))
    cut = chunks(drawn, "lang", "rank", "text", CHUNK_SIZES)
    spots = Window.partitionBy("label").orderBy("rank", "chunk")
    kept = cut.withColumn("spot", F.row_number().over(spots)).where(F.col("spot") <= SAMPLE_CHUNKS)
    with passing_tables(docs.sparkSession):
        kept = stored(kept.select("label", "rank", "chunk"), "chunks")
        size = kept.count()
        if size and len(model.languages) > 1:
            shard = F.pmod(F.xxhash64("rank", "chunk"), F.lit(-(-size // SHARD_CHUNKS)))
            trained = kept.withColumn("shard", shard).groupBy("shard").applyInPandas(_trained(model), TRAINED)
            model.average(trained.collect())
    return model


TRAINED = "shard long, chunks long, weights binary, bias binary, trust binary"


def _trained(model: LanguageModel):
    """The classifiers of one shard of chunks."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values(["rank", "label", "chunk"])
        place = {name: k for k, name in enumerate(model.languages)}
        model.train([bytes(x) for x in frame["chunk"]], frame["label"].map(place).to_numpy())
        parts = [x.astype("<f4").tobytes() for x in (model.weights, model.bias, model.trust)]
        return pd.DataFrame([(frame["shard"].iloc[0], len(frame), *parts)], columns=["shard", "chunks", "weights", "bias", "trust"])

    return run


ADDED = StructType(
    [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
)


def identify_language(df: DataFrame, model: LanguageModel, *, text: str = "text", margin: float = 0.2, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``ambiguous`` of every whole text.

    Null texts, texts without a letter and all texts under a model that learned
    nothing are ``und`` with score 0. A text is ambiguous if the two best languages
    are closer than ``margin``. Columns of the added names are replaced. One narrow
    pass; no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> dict:
        model = shared.value
        column = batch.column(batch.schema.get_field_index(text))
        texts, n = Texts.of(column), len(column)
        names, scores, unsure = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
        for low, high, block in texts.blocks():
            some = has_letter(block) if model.languages else np.zeros(len(block), dtype=bool)
            for a in range(0, len(block), ROWS):
                b = min(a + ROWS, len(block))
                odds = np.sort(weights := model.decode(ngram_matrix(block.part(a, b))), axis=1) if model.languages else None
                pick = np.flatnonzero(some[a:b])
                if len(pick):
                    at = low + a + pick
                    names[at] = np.array(model.languages, dtype=object)[weights[pick].argmax(axis=1)]
                    scores[at] = odds[pick, -1]
                    unsure[at] = odds[pick, -1] - (odds[pick, -2] if odds.shape[1] > 1 else 0) < margin
        return {"lang_pred": pa.array(names, pa.string()), "score": scores, "ambiguous": unsure}

    return add_columns(df, ADDED, judge, keep=keep)
