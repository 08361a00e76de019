"""Stable row hashes that other SQL engines compute alike."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 100


def hash_bucket(key: Column) -> Column:
    """0..99 from the first 32 bits of the key's md5; depends on the key alone."""
    head = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % BUCKETS


def row_bucket(df: DataFrame) -> Column:
    """0..99 from all columns of a row: exact copies get the same."""
    return F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]), F.lit(BUCKETS))
