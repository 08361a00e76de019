"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The most frequent words are cut into classes in the order of their counts; all other
words are one more class. A word's probability is that of its class times that within
its class. Both are softmaxes over weights of hashed features: preceding words (n-grams)
and words further back (skips). The class of all other words is a tree over the digits
of their hashes, sixteen ways at every node, whose depth follows the number of counted
words: every node is a softmax over the same features, so context chooses among rare
words too. The few words of one leaf share it by their counts. Weights start so that the
model equals the smoothed unigram model and then follow the gradient. Every round deals
its documents into shards of a given number of tokens, by hash, whatever the cluster;
each shard takes small steps from the shared weights, and the changes of every row of
weights are averaged over the shards that touched it.

Counts of words are shuffled by word and stay distributed. Those of the most frequent
words, a bounded number, travel as a broadcast; rarer words are joined with the rest.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagcast.llm.arrays import U64, Spans, Texts, mix
from lagcast.llm.components import arrow_rows, stored
from lagcast.llm.pretokens import Memory

VOCABULARY = 1024
CLASS_SIZE = 32
HEAD = 200_000  # words whose counts are broadcast: 16 bytes each
WAYS, DIGIT = 16, 4  # children of a node, bits of a digit
# Bits of hashed features at the least; they grow with the bits of the number of words.
CLASS_BUCKETS, CLASS_LESS = 11, 11  # of classes
WORD_BUCKETS, WORD_LESS = 8, 15  # within classes
TREE_BUCKETS, TREE_LESS = 9, 9  # of all nodes of the tree together
LEAF_LESS = 2  # about four words a leaf, to the next digit
# Bounds of what a task holds, in bytes of each table and in digits of the tree. Beyond
# them buckets and leaves are shared by more words; these still differ by their counts.
TABLE_BYTES = 1 << 25
MOST_DIGITS = 5
ROUNDS = 3
STEP = 16_384  # tokens of one gradient step
RATE = 0.6
SHARD_TOKENS = 1_000_000  # of a round: what one task trains on
BATCH_ROWS = 1000  # texts that a task holds at once
BLOCKS = 16  # parts in which changes of weights travel

CHANGES = "shard int, block int, rows binary, met binary, change binary"

END = U64(0x9216D5D98979FB1B)
BEGIN = U64(0xD1310BA698DFB5AC)
LOG10 = np.log(10.0)


class Tokens:
    """The tokens of a block of texts: hashes of lower-cased words, each text closed by an end."""

    def __init__(self, texts: Texts):
        starts, ends, first = texts.words()
        n = len(texts)
        self.bounds = first + np.arange(n + 1)
        self.hashes = np.full(len(starts) + n, END)
        word = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
        self.hashes[word] = Spans(texts.data, lower=True).hashes(starts, ends)
        self.text = np.repeat(np.arange(n), np.diff(self.bounds))
        self.place = np.arange(len(self.hashes)) - self.bounds[:-1][self.text]

    def contexts(self) -> list[np.ndarray]:
        """What features are made of: the word before, the one before that, and both."""
        one, two = self.back(1), self.back(2)
        return [one, two, mix(one * U64(0xC2B2AE3D27D4EB4F) + two)]

    def back(self, k: int) -> np.ndarray:
        """The token ``k`` places before each token, or the mark of the beginning."""
        out = np.full(len(self.hashes), BEGIN)
        out[k:] = self.hashes[:-k]
        out[self.place < k] = BEGIN
        return out


def _bucket(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(hashes + U64(salt * 0x452821E638D01377 & 0xFFFFFFFFFFFFFFFF)) >> U64(64 - bits)).astype(np.int64)


class Counts:
    """Totals of the training corpus, the counts of its most frequent words, the masses of the tree's leaves."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, leaves: np.ndarray):
        self.words, self.counts, self.tokens, self.kinds, self.leaves = words, counts, tokens, kinds, leaves

    def index(self) -> Memory:
        if "_index" not in self.__dict__:
            table = Memory(max(10, int(2 * len(self.words)).bit_length()))
            n = len(self.words)
            table.add(self.words, np.zeros(n, U64), np.ones(n, np.int32), np.arange(n, dtype=np.uint32))
            self._index = table
        return self._index

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word among the frequent ones, or -1."""
        table = self.index()
        slots = table.find(hashes)
        return np.where(slots >= 0, table.pool[table.starts[slots]].astype(np.int64), -1)


def _bits(kinds: int, least: int, less: int, row: int) -> int:
    """Bits of buckets whose rows have ``row`` bytes: as the words ask, within the bound of a table."""
    most = (TABLE_BYTES // row).bit_length() - 1
    return max(1, min(most, max(least, int(kinds).bit_length() - less)))


def _digits(kinds: int) -> int:
    """Digits of the tree over so many words."""
    return min(MOST_DIGITS, max(1, round((int(kinds).bit_length() - LEAF_LESS) / DIGIT)))


class Tree:
    """Decisions among the words without a class of their own, by the leading digits of their hashes.

    A node's offsets are the logarithms of its children's shares of the mass below it; one
    of mass 0 is never chosen. Features are the word before and the one before that. Nodes with a single child decide nothing.
    """

    def __init__(self, leaves: np.ndarray, bits: int):
        self.bits = bits
        self.depth = max(1, round((len(leaves).bit_length() - 1) / DIGIT))
        self.offsets, self.open, mass = [], [], leaves.astype(float)
        while len(mass) > 1:
            children = mass.reshape(-1, WAYS)
            self.open.insert(0, (children > 0).sum(axis=1) > 1)
            mass = children.sum(axis=1)
            share = children / np.maximum(mass, 1e-9)[:, None]
            self.offsets.insert(0, np.where(share > 0, np.log(np.maximum(share, 1e-30)), -1e4).astype(np.float32))
        self.log_leaves = np.log(np.maximum(leaves, 1e-9)).astype(np.float32)
        self.weights = np.zeros((1 << bits, WAYS), dtype=np.float32)

    def leaf(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - DIGIT * self.depth)).astype(np.int64)

    def decisions(self, leaf: np.ndarray, contexts: list[np.ndarray]):
        """Of each level: the words it decides on, their offsets, the children taken, and the rows of the features."""
        for level in range(self.depth):
            node = leaf >> DIGIT * (self.depth - level)
            word = np.flatnonzero(self.open[level][node])
            if not len(word):
                continue
            node = node[word]
            child = leaf[word] >> DIGIT * (self.depth - level - 1) & (WAYS - 1)
            salt = (node + WAYS**level).astype(U64) * U64(0x9E3779B97F4A7C15)
            rows = [((c[word] ^ salt) * U64(0xD6E8FEB86659FD93) >> U64(64 - self.bits)).astype(np.int64) for c in contexts[:2]]
            yield word, self.offsets[level][node], child, rows

    def logs(self, hashes: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Log probability of the leaf of each word."""
        out = np.zeros(len(hashes))
        for word, offsets, child, rows in self.decisions(self.leaf(hashes), contexts):
            out[word] += _logs(self.weights, rows, offsets, child)
        return out


class MaxentModel:
    """Weights of the two softmaxes and of the tree; their sizes follow the number of words."""

    def __init__(self, counts: Counts):
        size = min(VOCABULARY, len(counts.words))
        self.classes = -(-size // CLASS_SIZE)
        self.size = size
        known = counts.counts[:size].astype(float)
        self.rare_mass = float(counts.tokens - known.sum() + counts.kinds - size + 1)
        inside = np.full(self.classes * CLASS_SIZE, -1e4, dtype=np.float32)
        inside[:size] = np.log((known + 1) / (known.max(initial=0) + 1))
        mass = np.zeros(self.classes * CLASS_SIZE)
        mass[:size] = known + 1
        self.class_bits = _bits(counts.kinds, CLASS_BUCKETS, CLASS_LESS, 12 * (self.classes + 1))
        self.word_bits = _bits(counts.kinds, WORD_BUCKETS, WORD_LESS, 12 * CLASS_SIZE * max(self.classes, 1))
        self.tree = Tree(counts.leaves, _bits(counts.kinds, TREE_BUCKETS, TREE_LESS, 4 * WAYS))
        of_class = np.append(mass.reshape(-1, CLASS_SIZE).sum(axis=1), self.rare_mass)
        self.class_weights = np.zeros((1 + (3 << self.class_bits), self.classes + 1), dtype=np.float32)
        self.class_weights[0] = np.log(of_class / of_class.sum())
        self.word_weights = np.zeros(((1 + (3 << self.word_bits)) * self.classes, CLASS_SIZE), dtype=np.float32)
        self.word_weights[: self.classes] = inside.reshape(-1, CLASS_SIZE)

    def class_rows(self, contexts: list[np.ndarray]) -> list[np.ndarray]:
        return [_bucket(h, k + 1, self.class_bits) + (k << self.class_bits) + 1 for k, h in enumerate(contexts)]

    def word_rows(self, contexts: list[np.ndarray], some: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
        rows = [_bucket(h[some], k + 11, self.word_bits) + (k << self.word_bits) + 1 for k, h in enumerate(contexts)]
        return [group, *(r * self.classes + group for r in rows)]

    @property
    def tables(self) -> list[np.ndarray]:
        return [self.class_weights, self.word_weights, self.tree.weights]

    def groups_of(self, ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks >= 0) & (ranks < self.size), ranks // CLASS_SIZE, self.classes)


HIGHEST = 60.0  # of a logit: offsets are 0 at most, so none comes near what a float can hold


def _raised(table: np.ndarray, rows: list[np.ndarray], shared: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of the logits, and their sums."""
    z = table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    if shared is not None:
        z += shared
    np.minimum(z, HIGHEST, out=z)
    np.exp(z, out=z)
    return z, np.maximum(z @ np.ones(z.shape[1], dtype=z.dtype), 1e-30)


def _errors(table: np.ndarray, rows: list[np.ndarray], shared: np.ndarray | None, target: np.ndarray) -> np.ndarray:
    """Probabilities less one at the target."""
    error, total = _raised(table, rows, shared)
    error *= (1 / total)[:, None]
    error[np.arange(len(target)), target] -= 1
    return error


def _logs(table: np.ndarray, rows: list[np.ndarray], shared: np.ndarray | None, target: np.ndarray) -> np.ndarray:
    """The log probability of the target."""
    raised, total = _raised(table, rows, shared)
    return np.log(np.maximum(raised[np.arange(len(target)), target], 1e-30) / total)


def _sums(ordered: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; most runs are short, and those are added up all at once."""
    sizes = np.diff(np.append(first, len(ordered)))
    sums = ordered[first]
    more, k = np.flatnonzero(sizes > 1), 1
    while len(more) and k < 4:
        sums[more] += ordered[first[more] + k]
        k += 1
        more = more[sizes[more] > k]
    if len(more):
        left = sizes[more] - k
        starts = np.cumsum(left) - left
        rest = np.arange(left.sum()) + np.repeat(first[more] + k - starts, left)
        sums[more] += np.add.reduceat(ordered[rest], starts, axis=0)
    return sums


class _Table:
    """A weight table in training, with a step size per row."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.slopes = np.full(len(weights), 1.0, dtype=np.float32)

    def step(self, rows: np.ndarray, error: np.ndarray) -> None:
        packed = np.sort(rows << 16 | np.arange(len(rows)))  # at most 65536 rows at once
        ordered, order = packed >> 16, packed & 0xFFFF
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        slope, at = _sums(error[order], first), ordered[first]
        slopes = self.slopes[at] + np.einsum("ij,ij->i", slope, slope)
        self.slopes[at] = slopes
        slope *= (RATE / np.sqrt(slopes))[:, None]
        self.weights[at] -= slope

    def step_all(self, error: np.ndarray) -> None:
        """A step of the weights that every token has, in row 0."""
        slope = error.sum(axis=0)
        self.slopes[0] += slope @ slope
        self.weights[0] -= RATE * slope / np.sqrt(self.slopes[0])


def train_block(model: MaxentModel, tables: list[_Table], tokens: Tokens, ranks: np.ndarray) -> None:
    """Gradient steps on the tokens of one block, in place."""
    group = model.groups_of(ranks)
    contexts = tokens.contexts()
    class_rows = model.class_rows(contexts)
    for low in range(0, len(ranks), STEP):
        part = slice(low, low + STEP)
        target = group[part]
        rows = [r[part] for r in class_rows]
        error = _errors(tables[0].weights, rows, tables[0].weights[0], target)
        for r in rows:
            tables[0].step(r, error)
        tables[0].step_all(error)
    others = np.flatnonzero(group == model.classes)
    for low in range(0, len(others), STEP):
        part = others[low : low + STEP]
        for word, offsets, child, rows in model.tree.decisions(model.tree.leaf(tokens.hashes[part]), [c[part] for c in contexts]):
            error = _errors(tables[2].weights, rows, offsets, child)
            for r in rows:
                tables[2].step(r, error)
    some = np.flatnonzero(group < model.classes)
    if not len(some):
        return
    rows, spot = model.word_rows(contexts, some, group[some]), ranks[some] % CLASS_SIZE
    for low in range(0, len(some), STEP):
        part = [r[low : low + STEP] for r in rows]
        error = _errors(tables[1].weights, part, None, spot[low : low + STEP])
        for r in part:
            tables[1].step(r, error)


def score_block(model: MaxentModel, tokens: Tokens, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability of each token, of rare ones that of being rare; and, of rare ones, what to add if they are counted.

    Of a counted word that is the log10 probability of its leaf over the leaf's mass,
    so that its count is left to be multiplied. All words without a count share a mass of one.
    """
    group = model.groups_of(ranks)
    contexts = tokens.contexts()
    class_rows = model.class_rows(contexts)
    out = np.zeros(len(ranks))
    for low in range(0, len(ranks), STEP):
        part = slice(low, low + STEP)
        out[part] = _logs(model.class_weights, [r[part] for r in class_rows], model.class_weights[0], group[part])
    some = np.flatnonzero(group < model.classes)
    if len(some):
        rows, spot = model.word_rows(contexts, some, group[some]), ranks[some] % CLASS_SIZE
        for low in range(0, len(some), STEP):
            part = [r[low : low + STEP] for r in rows]
            out[some[low : low + STEP]] += _logs(model.word_weights, part, None, spot[low : low + STEP])
    more = np.zeros(len(ranks))
    others = np.flatnonzero(group == model.classes)
    known = np.log(max(model.rare_mass - 1, 1) / model.rare_mass)
    for low in range(0, len(others), STEP):
        part = others[low : low + STEP]
        hashes = tokens.hashes[part]
        leaves = model.tree.logs(hashes, [c[part] for c in contexts])
        more[part] = known + leaves - model.tree.log_leaves[model.tree.leaf(hashes)]
    return out / LOG10, more / LOG10


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (a hash) and ``n`` for all tokens of ``docs``, ends included."""

    def count(batches):
        for batch in batches:
            words, numbers = [], []
            for _, _, block in Texts.of(batch.column(0)).blocks(1 << 23):
                found, n = np.unique(Tokens(block).hashes, return_counts=True)
                words.append(found.view(np.int64))
                numbers.append(n)
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(words)), pa.array(np.concatenate(numbers).astype(np.int64))], names=["word", "n"]
                )

    counted = docs.select(text).mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> Counts:
    """The totals of stored counts and their most frequent words."""
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    words, n, kinds = head["word"].to_numpy().view(U64), head["n"].to_numpy(), int(total[1])
    depth = DIGIT * _digits(kinds)
    masses = counts.groupBy(F.shiftrightunsigned("word", 64 - depth).alias("leaf")).agg(F.sum(F.col("n") + 1).alias("mass")).toArrow()
    leaves = np.zeros(1 << depth)
    leaves[masses["leaf"].to_numpy()] = masses["mass"].to_numpy()
    np.subtract.at(leaves, (words[:VOCABULARY] >> U64(64 - depth)).astype(np.int64), n[:VOCABULARY] + 1.0)
    return Counts(words, n, int(total[0] or 0), kinds, leaves.astype(np.float32))


def fit_maxent(
    docs: DataFrame, counts: Counts, *, text: str = "text", spread: Column | None = None, rounds: int = ROUNDS,
    shard_tokens: int = SHARD_TOKENS,
) -> MaxentModel:
    """Trains on all of ``docs``: each round on its share of them, dealt by ``spread``.

    A round has a shard for every ``shard_tokens`` of its tokens, which one task trains
    on in the order of ``spread`` and text, so neither cores nor partitions change the
    result. A shard sends the rows of weights it touched, as 16-bit numbers; they are
    summed in two steps of tasks that hold one block of rows at a time. Without a word
    nothing is trained.
    """
    spark = docs.sparkSession
    model = MaxentModel(counts)
    if not model.classes:
        return model
    known = spark.sparkContext.broadcast(counts)
    shards = max(1, -(-counts.tokens // (rounds * shard_tokens)))
    groups = int(np.ceil(np.sqrt(shards)))
    spot = F.xxhash64(text) if spread is None else spread
    dealt = docs.select(F.col(text).alias("text"), spot.alias("spot"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("spot", F.lit(1)), F.lit(shards)).cast("int"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = dealt.where(F.pmod("spot", F.lit(rounds)) == turn)
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "spot", "text")
        with arrow_rows(spark, BATCH_ROWS):
            changes = part.select("text", "shard").mapInArrow(_changes(shared, known), CHANGES)
            for keys in (["block", F.pmod("shard", F.lit(groups))], ["block"]):
                changes = changes.repartition(*keys).mapInArrow(_summed, CHANGES)
            blocks = changes.collect()  # every row of weights once at most
        for row in blocks:
            table, width = _place(model, row.block)
            rows, met = np.frombuffer(row.rows, np.int32), np.frombuffer(row.met, np.float32)
            table[rows] += np.frombuffer(row.change, np.float32).reshape(-1, width) / met[:, None]
        shared.unpersist()
    return model


def _place(model: MaxentModel, block: int) -> tuple[np.ndarray, int]:
    table = model.tables[block // BLOCKS]
    return table, table.shape[1]


def _changes(shared, known):
    """What a shard's steps change: the rows they touched, each by the block it belongs to."""

    def sent(shard: int, model: MaxentModel, tables: list[_Table]):
        for k, (table, before) in enumerate(zip(tables, model.tables)):
            touched = np.flatnonzero(table.slopes > 1)
            blocks = touched * BLOCKS // len(before)
            for b in range(BLOCKS):
                rows = touched[blocks == b]
                if len(rows):
                    change = (table.weights[rows] - before[rows]).astype(np.float16)
                    yield _change_row(shard, k * BLOCKS + b, rows.astype(np.int32), np.zeros(0, np.float32), change)

    def run(batches):
        model, counts = shared.value, known.value
        shard, tables = None, []
        for batch in batches:
            texts, shards = Texts.of(batch.column(0)), batch.column(1).to_numpy()
            bounds = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
            for start, end in zip(bounds[:-1], bounds[1:]):
                if shards[start] != shard:
                    if tables:
                        yield from sent(shard, model, tables)
                    shard, tables = int(shards[start]), [_Table(t.copy()) for t in model.tables]
                for _, _, block in texts.part(start, end).blocks():
                    tokens = Tokens(block)
                    train_block(model, tables, tokens, counts.find(tokens.hashes))
        if tables:
            yield from sent(shard, model, tables)

    return run


def _change_row(shard: int, block: int, rows: np.ndarray, met: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32())]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (rows, met, change)]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "block", "rows", "met", "change"])


def _summed(batches):
    """Sums of the changes of each row in a block, and how many shards made them.

    Changes of one shard come as 16-bit numbers and without that count.
    """
    sums: dict[int, tuple] = {}
    for batch in batches:
        for shard, block, *sent in zip(*(c.to_pylist() for c in batch.columns)):
            rows, met = np.frombuffer(sent[0], np.int32), np.frombuffer(sent[1], np.float32)
            change = np.frombuffer(sent[2], np.float32 if len(met) else np.float16).astype(np.float32).reshape(len(rows), -1)
            met = met if len(met) else np.ones(len(rows), np.float32)
            if block in sums:
                _, known, times, total = sums[block]
                every, place = np.unique(np.concatenate([known, rows]), return_inverse=True)
                both, whole = np.zeros(len(every), np.float32), np.zeros((len(every), change.shape[1]), np.float32)
                both[place[: len(known)]], whole[place[: len(known)]] = times, total
                both[place[len(known) :]] += met
                whole[place[len(known) :]] += change
                rows, met, change = every.astype(np.int32), both, whole
            sums[block] = (shard, rows, met, change)
    for block, (shard, rows, met, change) in sums.items():
        yield _change_row(shard, block, rows, met, change)


WORDS = "key {key}, row long, n_tokens long, n_known long, base double, score double, rare array<bigint>, more array<double>"


def score_documents(
    df: DataFrame, model: MaxentModel, counts: Counts, words: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    A null or empty text is one end token. Both scores are log10 probabilities: of the
    add-one unigram model and of the maximum-entropy model. Rows are scored each by
    itself, repeated ones and those with equal or null keys too. Words beyond the
    broadcast head are joined with ``words``, the counts of the training corpus.
    """
    spark = df.sparkSession
    shared, known = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(counts)
    total, kinds = counts.tokens, counts.kinds
    rare_mass, size = model.rare_mass, model.size

    def run(batches):
        from pyspark import TaskContext

        model, counts = shared.value, known.value
        base = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            for low, high, block in Texts.of(batch.column(1)).blocks():
                tokens = Tokens(block)
                ranks = counts.find(tokens.hashes)
                head = ranks >= 0
                n = np.where(head, counts.counts[np.maximum(ranks, 0)] if len(counts.words) else 0, 0)
                share = np.log10(n + 1.0)
                logs, more = score_block(model, tokens, ranks) if model.classes else (np.zeros(len(ranks)), np.zeros(len(ranks)))
                logs += np.where(ranks >= size, share + more, 0)
                bounds = tokens.bounds
                tail = np.flatnonzero(~head)
                ends = np.searchsorted(tail, bounds).astype(np.int32)
                rows = high - low
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high],
                        pa.array(np.arange(rows) + base + 1),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(np.add.reduceat(head, bounds[:-1]).astype(np.int64)),
                        pa.array(np.add.reduceat(np.where(head, share, 0.0), bounds[:-1])),
                        pa.array(np.add.reduceat(logs, bounds[:-1])),
                        pa.ListArray.from_arrays(
                            pa.array(ends),
                            pa.array(tokens.hashes[tail].view(np.int64)),
                            type=pa.list_(pa.field("element", pa.int64(), nullable=False)),
                        ),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(more[tail])),
                    ],
                    names=["key", "row", "n_tokens", "n_known", "base", "score", "rare", "more"],
                )
                base += rows

    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    scored = stored(docs.mapInArrow(run, WORDS.format(key=kind)), "scored", BATCH_ROWS)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "more")).alias("rare")).select("row", F.col("rare.rare").alias("word"), "rare.more")
    rare = rare.groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"), F.sum("more").alias("more"))
    counted = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum("times").alias("times"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("share"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("more")).otherwise(0.0)).alias("more"),
    )
    whole = scored.drop("rare", "more").join(counted, "row", "left").fillna({"times": 0, "known": 0, "share": 0.0, "more": 0.0})
    return whole.select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("share") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        (
            F.col("score") + F.col("share") + F.col("more") - (F.col("times") - F.col("known")) * F.lit(float(np.log10(rare_mass)))
        ).alias("score"),
    )
