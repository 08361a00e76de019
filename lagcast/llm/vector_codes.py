"""Codes of vectors: one of 64 entries for each of 16 parts.

Components become whole numbers. The distinct parts of a batch of vectors form a
lexicographic trie, one level for each component. A depth-first traversal carries the
distances to all entries, summed up to a node, so parts with a common prefix share that
work; a leaf takes the nearest entry and adds its part, weighted by how often it occurs,
to that entry's sum. A subtree is entered in slabs of nodes, so the traversal holds one
slab of distances for each level.

Nothing is shuffled to learn the entries but sums: a row for each task, part and entry.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagcast.llm.arrays import add_columns
from lagcast.llm.components import arrow_rows, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BATCH_ROWS = 10_000  # vectors whose parts form one trie
SLAB = 4096  # nodes whose distances are held at each level
# Components beyond this bound are set to it: of 64 of them, squared distances still fit 64 bits.
BOUND = 1 << 27


class Trie:
    """The distinct rows of a matrix of whole numbers, in order, by common prefixes.

    ``values[d]`` has the component of every node of level ``d``, ``below[d]`` where the
    children of every node of level ``d - 1`` begin in it; level -1 is the root alone.
    """

    def __init__(self, rows: np.ndarray):
        width = rows.shape[1]
        order = np.lexsort(rows.T[::-1]) if width else np.arange(len(rows))
        ordered = rows[order]
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        self.values, self.below, starts = [], [], np.zeros(1, dtype=np.int64)
        for d in range(width):
            new[1:] |= ordered[1:, d] != ordered[:-1, d]
            found = np.flatnonzero(new)
            self.values.append(ordered[found, d])
            self.below.append(np.append(np.searchsorted(found, starts), len(found)))
            starts = found
        self.rows = ordered[starts] if len(rows) else ordered
        self.weights = np.diff(np.append(starts, len(rows))) if len(rows) else np.zeros(0, dtype=np.int64)
        self.leaf = np.empty(len(rows), dtype=np.int64)
        self.leaf[order] = np.repeat(np.arange(len(self.weights)), self.weights)

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every leaf, the lower of equally near ones, and its squared distance."""
        index, distance = np.zeros(len(self.rows), dtype=np.int64), np.zeros(len(self.rows), dtype=np.int64)

        def visit(level: int, low: int, high: int, sums: np.ndarray) -> None:
            """Nodes ``low`` to ``high`` of the level above, with their distances so far."""
            if level == len(self.values):
                index[low:high] = sums.argmin(axis=1)
                distance[low:high] = sums.min(axis=1)
                return
            below = self.below[level][low : high + 1]
            for start in range(below[0], below[-1], SLAB):
                end = min(start + SLAB, below[-1])
                above = np.searchsorted(below, np.arange(start, end), "right") - 1
                gap = self.values[level][start:end, None] - entries[:, level]
                gap *= gap
                gap += sums[above]
                visit(level + 1, start, end, gap)

        if len(self.rows):
            visit(0, 0, 1, np.zeros((1, len(entries)), dtype=np.int64))
        return index, distance

    def sums(self, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """How many rows took each entry, and the sums of their components."""
        counts = np.zeros(entries, dtype=np.int64)
        np.add.at(counts, index, self.weights)
        totals = np.zeros((entries, self.rows.shape[1]), dtype=np.int64)
        np.add.at(totals, index, self.rows * self.weights[:, None])
        return counts, totals


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]`` are the entries of part ``p``: 64 rows at most, as wide as the part."""

    entries: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def digest(self) -> str:
        """The sha256 of all components by part, entry and position."""
        text = ",".join(str(x) for part in self.entries for entry in part.tolist() for x in entry)
        return hashlib.sha256(text.encode()).hexdigest()


def whole_parts(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors by part and position, as the floors of their scaled components.

    Missing components at the end are 0.
    """
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    numbers = np.clip(flat, -BOUND, BOUND).astype(np.int64)
    out = np.zeros((len(vectors), PARTS * width), dtype=np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = numbers
    return out.reshape(len(vectors), PARTS, width)


def _kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.col(vector).isNotNull() & finite)


def fit_codebooks(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Entries that start as the parts of the vectors with the smallest keys and move to the means.

    Of equal keys the smaller vector counts as first; null keys are last. With fewer
    than ``ENTRIES`` vectors there are fewer entries, without vectors none. Parts are
    as wide as the longest vector asks; shorter ones are filled with zeros. An entry
    that no part took stays. The driver holds the entries and their sums, whose number
    does not grow with the vectors.
    """
    spark = df.sparkSession
    rows = _kept(df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")), "vector")
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS)
    first = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(ENTRIES).select("vector").toArrow()
    starts = whole_parts(first["vector"].combine_chunks(), width)
    books = Codebooks([starts[:, p] for p in range(PARTS)])
    if not len(starts):
        return books
    totals = [F.sum(f"s{d}").alias(f"s{d}") for d in range(width)]
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(f"s{d}", T.LongType()) for d in range(width)]
    )
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(books)
        with arrow_rows(spark, BATCH_ROWS):
            summed = rows.select("vector").mapInArrow(_partial_sums(shared), schema)
            found = summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).toArrow()
        entries = [e.copy() for e in books.entries]
        counts = found["n"].to_numpy()
        means = np.column_stack([found[f"s{d}"].to_numpy() // counts for d in range(width)]) if width else None
        for k, (p, e) in enumerate(zip(found["part"].to_pylist(), found["entry"].to_pylist())):
            if width:
                entries[p][e] = means[k]
        books = Codebooks(entries)
    return books


def _partial_sums(shared):
    """Of a task's vectors: how many parts took each entry, and the sums of these parts."""

    def run(batches):
        entries = shared.value.entries
        width, size = shared.value.width, len(entries[0])
        counts, totals = np.zeros((PARTS, size), dtype=np.int64), np.zeros((PARTS, size, width), dtype=np.int64)
        for batch in batches:
            parts = whole_parts(batch.column(0), width)
            for p in range(PARTS):
                trie = Trie(parts[:, p])
                index, _ = trie.nearest(entries[p])
                n, total = trie.sums(index, size)
                counts[p] += n
                totals[p] += total
        part, entry = np.nonzero(counts)
        if len(part):
            columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
            columns += [totals[part, entry, d] for d in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["part", "entry", "n", *(f"s{d}" for d in range(width))]
            )

    return run


HEX = np.array([f"{k:02x}" for k in range(256)])


def encode_vectors(df: DataFrame, books: Codebooks, *, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` with ``code`` (two hex digits for each part) and ``error``.

    Rows whose vector is null or has a null or non-finite component are left out.
    ``error`` is the sum of the squared distances of all parts. Columns of ``df`` named
    code or error are replaced. One narrow pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(books)

    def assign(batch: pa.RecordBatch) -> dict:
        entries, width = shared.value.entries, shared.value.width
        column = batch.column(batch.schema.get_field_index(vector))
        parts = whole_parts(column.cast(pa.list_(pa.float64())), width)
        code, error = np.zeros((len(parts), PARTS), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        for p in range(PARTS):
            trie = Trie(parts[:, p])
            index, distance = trie.nearest(entries[p])
            code[:, p] = index[trie.leaf]
            error += distance[trie.leaf]
        return {"code": pa.array(["".join(c) for c in HEX[code]], pa.string()), "error": error}

    added = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return add_columns(_kept(df, vector), added, assign, keep=keep)


def compress_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Key, code, error, label_error and codebooks_sha256 of every vector that is kept.

    ``label_error`` is the error summed over equal labels, null ones together; null if
    it exceeds 64 bits. Equal or null keys are rows each by itself. The codes are
    written once and read for the sums by label and for the result.
    """
    spark = df.sparkSession
    books = fit_codebooks(df, key=key, vector=vector)
    named = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    with arrow_rows(spark, BATCH_ROWS):
        coded = stored(encode_vectors(named, books, vector="vector", keep=["key", "label"]), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
