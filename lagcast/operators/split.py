"""Training and hold-out parts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.functions.hashing import BUCKETS, hash_bucket, row_bucket


def _bound(ratio: float) -> int:
    bound = round(ratio * BUCKETS)
    if abs(bound - ratio * BUCKETS) > 1e-9 or not 0 < bound < BUCKETS:
        raise ValueError("the ratio must be a whole number of hundredths between 0 and 1")
    return bound


def split(
    df: DataFrame,
    key: str | Column | None = None,
    ratio: float = fixed.SPLIT_RATIO,
    mode: str = "hash",
    seed: int = fixed.SPLIT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out parts of a table.

    ``hash`` puts a row where its key says: the same row lands in the same part
    however the table is partitioned, and after a lost executor too. Without a
    key, or where it is null, the whole row is the key, so exact copies stay together. Either way a
    row is placed where it is read, without a shuffle. ``random`` draws per
    partition; the same seed over another partitioning gives other parts.
    """
    if mode == "random":
        train, test = df.randomSplit([ratio, 1 - ratio], seed=seed)
        return train, test
    if mode != "hash":
        raise ValueError(f"unknown split mode {mode!r}")
    named = F.col(key) if isinstance(key, str) else key
    bucket = row_bucket(df) if named is None else F.coalesce(hash_bucket(named), row_bucket(df))
    training = bucket < F.lit(_bound(ratio))
    return df.filter(training), df.filter(~training)
