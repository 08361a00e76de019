"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors of length one are centred, projected on their principal directions and turned
by a rotation learned so that the signs lose little (alternating between codes and
rotation). The signs are a 64-bit code. A block of vectors is indexed once per
substring of the codes: for each value a bitmap of the rows that have it, and of those
that have one near it. By the pigeonhole principle a code within a Hamming radius
differs little from the query's in at least one substring, so probing every substring
for the near values finds every code within the radius. What it finds is ranked by the
cosine of the original vectors.

The radius is learned too: it covers nearly all true neighbours in a sample. Where a
block has fewer codes within it than neighbours are wanted, it grows.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
TABLES = 8
WIDTH = BITS // TABLES
BLOCK_VALUES = 1 << 20  # numbers in the vectors of an index
QUERY_VALUES = 1 << 20  # numbers in the queries that meet it at once
SAMPLE_VALUES = 1 << 20  # numbers that the rotation is learned from
SAMPLE_QUERIES = 400
COVERED = 0.995  # share of true neighbours in the sample that the radius covers
ITERATIONS = 30

VALUES = np.arange(1 << WIDTH)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; scaling by a power of two first avoids overflow."""
    scaled = scale(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def scale(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


class Codes:
    """The projection, and the radius to search."""

    def __init__(self, sample: np.ndarray, neighbours: int):
        rng = np.random.default_rng(11)
        units = unit(sample)
        self.mean = units.mean(axis=0)
        centred = units - self.mean
        directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        d = directions.shape[1]
        if d >= BITS:
            basis = directions[:, :BITS]
        else:  # more bits than dimensions: further directions between the principal ones
            basis = np.concatenate([directions, directions @ rng.normal(size=(d, BITS - d)) / np.sqrt(d)], axis=1)
        values = centred @ basis
        rotation = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(values @ rotation).T @ values)
            rotation = (u @ v).T
        self.projection = basis @ rotation
        self.radius = self._learned_radius(units, neighbours, rng)

    def of(self, units: np.ndarray) -> np.ndarray:
        bits = (units - self.mean) @ self.projection > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()

    def _learned_radius(self, units: np.ndarray, neighbours: int, rng: np.random.Generator) -> int:
        if len(units) < 2:
            return BITS
        codes = self.of(units)
        asked = rng.permutation(len(units))[:SAMPLE_QUERIES]
        nearness = units[asked] @ units.T
        nearness[np.arange(len(asked)), asked] = -2
        k = min(neighbours, len(units) - 1)
        best = np.argpartition(-nearness, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(codes[asked][:, None] ^ codes[best])
        return int(np.quantile(apart, COVERED, method="higher"))


class Index:
    """One table per substring: for each value, bitmaps of the rows that have one near it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.near = [[self._rows_by_value(self._part(codes, t))] for t in range(TABLES)]

    @staticmethod
    def _part(codes: np.ndarray, t: int) -> np.ndarray:
        return (codes >> np.uint64(t * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    @staticmethod
    def _rows_by_value(values: np.ndarray) -> np.ndarray:
        has = np.zeros((1 << WIDTH, len(values)), dtype=bool)
        has[values, np.arange(len(values))] = True
        return np.packbits(has, axis=1)

    def _reached(self, t: int, reach: int) -> np.ndarray:
        """The bitmaps of table ``t`` for values that differ in at most ``reach`` bits."""
        near = self.near[t]
        while len(near) <= reach:
            wider = near[-1].copy()
            for bit in range(WIDTH):
                wider |= near[-1][VALUES ^ 1 << bit]
            near.append(wider)
        return near[reach]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose codes differ from ``code`` in at most ``radius`` bits.

        With ``radius = TABLES * a + b``, such a code differs in at most ``a`` bits in one of
        the first ``b + 1`` substrings, or in at most ``a - 1`` in one of the others.
        """
        if radius >= BITS:
            return np.arange(len(self.codes))
        a, b = divmod(radius, TABLES)
        seen = np.zeros(-(-len(self.codes) // 8), dtype=np.uint8)
        for t in range(TABLES):
            reach = a if t <= b else a - 1
            if reach < 0:
                break
            seen |= self._reached(t, min(reach, WIDTH))[int(code) >> t * WIDTH & (1 << WIDTH) - 1]
        rows = np.flatnonzero(np.unpackbits(seen, count=len(self.codes)))
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _nearest(shared, k: int):
    """The nearest vectors of one block for each query of another."""

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        ids = block["id"].to_numpy()
        names = asked["id"].to_numpy()
        if len(block) and len(asked):
            codes = shared.value
            vectors, queries = (scale(np.stack(f["vector"].to_list())) for f in (block, asked))
            lengths, of_query = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, queries))
            units, ways = vectors / lengths[:, None], queries / of_query[:, None]
            index, asked_codes = Index(codes.of(units)), codes.of(ways)
            units, ways = units.astype(np.float32), ways.astype(np.float32)
            # Twice what rounding can move a cosine in single precision.
            slack = (units.shape[1] + 4) * 2.0**-22
            for name, query, length, way, code in zip(names, queries, of_query, ways, asked_codes):
                radius = codes.radius
                while True:
                    rows = index.within(code, radius)
                    rows = rows[ids[rows] != name]
                    if len(rows) >= k or radius >= BITS:
                        break
                    radius = min(BITS, radius + TABLES // 2)
                if len(rows) > k:  # those that cannot be among the nearest need no exact score
                    rough = units[rows] @ way
                    rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - slack]
                # Sums along rows are the same for equal vectors, wherever they stand.
                score = (vectors[rows] * query).sum(axis=1) / (lengths[rows] * length)
                best = np.lexsort((ids[rows], -score))[:k]
                found.append(rows[best])
                scores.append(score[best])
        rows = np.concatenate([np.zeros(0, dtype=np.int64), *found])
        turns = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return pd.DataFrame({"query_id": names[turns], "vec_id": ids[rows], "score": np.concatenate([np.zeros(0), *scores])})

    return run


def usable(vector: str | Column) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame, is_query: Callable[[Column], Column], *, key: str = "vec_id", vector: str = "embedding", k: int = 5
) -> DataFrame:
    """The ``k`` nearest rows for every row of ``df`` whose key ``is_query`` selects.

    Returns query_id, rank, vec_id, score: the cosine in double precision, nearest first,
    ties to the smaller key; all other rows, if there are fewer than ``k``. Null vectors,
    zero vectors, and those with null or non-finite components take no part, nor do rows
    with a null key or whose vectors have another dimension than most (of equally frequent
    ones, the larger). Repeated rows count once; a row is no neighbour of its own key.

    Vectors are dealt into blocks by a hash, of ``BLOCK_VALUES`` numbers on average; a
    block's index meets queries of ``QUERY_VALUES`` numbers at a time and returns ``k`` rows
    for each. Single-precision vectors travel as such; scores are in double precision.
    """
    narrow = df.schema[vector].dataType.simpleString() == "array<float>"
    numbers = F.col(vector).cast("array<float>" if narrow else "array<double>")
    rows = df.select(F.col(key).alias("id"), numbers.alias("vector")).where(F.col("id").isNotNull() & usable("vector"))
    spark = df.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dimension, total = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("vector") == dimension).dropDuplicates(["id", "vector"])
    spot = F.xxhash64("id", "vector")
    sample = rows.orderBy(spot, "id").limit(max(64, SAMPLE_VALUES // dimension)).select("vector").toArrow()
    values = sample["vector"].combine_chunks().flatten().to_numpy()
    codes = spark.sparkContext.broadcast(Codes(values.reshape(-1, dimension), k))
    asked = rows.where(is_query(F.col("id")))
    blocks, turns = -(-total * dimension // BLOCK_VALUES), max(1, -(-asked.count() * dimension // QUERY_VALUES))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("id", "vector", F.pmod(spot, F.lit(blocks)).cast("int").alias("block"), number(turns).alias("turn"))
    met = asked.select("id", "vector", number(blocks).alias("block"), F.pmod(spot, F.lit(turns)).cast("int").alias("turn"))
    found = (
        dealt.groupBy("block", "turn").cogroup(met.groupBy("block", "turn")).applyInPandas(_nearest(codes, k), schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
