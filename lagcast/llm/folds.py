"""Folds of rows by the checksum of their key, and bounded samples by hash."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str | Column, folds: int) -> Column:
    """The fold of a row: the crc32 of its key as text; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % folds


def is_fold(key: str | Column, folds: int, number: int) -> Column:
    """Whether a row lies in one fold; a null key lies in none."""
    return F.coalesce(fold(key, folds) == number, F.lit(False))


def smallest(df: DataFrame, n: int, *by: Column) -> DataFrame:
    """The ``n`` rows with the smallest values: a bounded sample if ``by`` is a hash.

    Every task keeps ``n`` rows at most, so neither a task nor the driver gathers more.
    """
    return df.orderBy(*by).limit(n)


def chunks(df: DataFrame, label: str, rank: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """Texts cut into chunks of bytes: label, chunk and a new rank for sampling chunks evenly.

    The sizes take turns, starting where the text's rank says.
    """

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for kind, place, content in zip(*(c.to_pylist() for c in batch.columns)):
                content, at, turn = content.encode(), 0, place
                while at < len(content):
                    size = sizes[turn % len(sizes)]
                    spot = (place * 0x9E3779B97F4A7C15 + at * 0xD6E8FEB86659FD93) % (1 << 63)
                    out.append((kind, content[at : at + size], spot))
                    at, turn = at + size, turn + 1
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.types[0]), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
                names=["label", "chunk", "rank"],
            )

    source = df.where(F.length(text) > 0).select(F.col(label).alias("label"), F.col(rank).alias("rank"), F.col(text).alias("text"))
    return source.mapInArrow(cut, f"label {source.schema['label'].dataType.simpleString()}, chunk binary, rank long")
