"""Columns that are computed once per row, whatever is built on them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fields(df: DataFrame, struct: Column, *kept: str) -> DataFrame:
    """The ``kept`` columns of ``df`` and the fields of a struct.

    Filters on plain projected columns are moved below the projection, where
    each mention of a column repeats its whole expression; a JSON document would
    be parsed once per field tested. They are not moved below a generator, so
    the fields come out of one, which gives a row for a row.
    """
    return df.select(*kept, F.inline(F.array(struct)))


def with_computed(df: DataFrame, columns: dict[str, Column], *kept: str) -> DataFrame:
    """The ``kept`` columns of ``df`` and named expressions."""
    return with_fields(df, F.struct(*[c.alias(n) for n, c in columns.items()]), *kept)
