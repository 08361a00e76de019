"""JSON messages to columns and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}

# What a plain decimal number looks like; keeps out forms such as 1.5f or 0x1p3
# which the JVM would read as numbers.
NUMBER_PATTERN = (
    r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)


def decode(payload: Column, schema: T.StructType) -> Column:
    """Message text or bytes as a struct; undecodable ones have only null fields."""
    return F.from_json(payload.cast("string"), schema, _STRICT)


def encode(*fields: str | Column) -> Column:
    """A JSON message with the given fields; null fields are kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


# What may be a whole number. A failed cast raises and catches inside the JVM,
# which costs far more than the look at the text that avoids it.
INTEGER_PATTERN = r"^\s*([+-]?0*[0-9]{1,10})(\.0*)?\s*$"


def as_integer(text: Column) -> Column:
    """Whole number or null; ``7.0`` is whole, ``5.7`` is not."""
    return F.when(text.rlike(INTEGER_PATTERN), F.regexp_extract(text, INTEGER_PATTERN, 1).try_cast("int"))


def as_decimal(text: Column) -> Column:
    """Number or null; a bare JSON Infinity comes wrapped in quotes."""
    plain = F.btrim(text, F.lit('"'))
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))
