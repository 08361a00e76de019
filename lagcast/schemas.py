"""Declared schemas: nothing in this library infers types unless asked to."""

from pyspark.sql import types as T

from lagcast.fixed import VOCABULARY_FIELDS

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

FLIGHT_TYPES = {
    "DepDelayMinutes": _D,
    # A wall-clock time: its hour must not move with the session time zone.
    "Time": T.TimestampNTZType(),
    "Origin": _S,
    "Dest": _S,
    "Carrier": _S,
    "Temperature": _D,
    "Wind_Speed": _D,
    "Precipitation": _D,
    "Visibility": _D,
    "Wind_Gust": _D,
    "Ice_Accretion_3hr": _D,
}

FLIGHTS = T.StructType([T.StructField(n, t) for n, t in FLIGHT_TYPES.items()])

CATEGORY_FIELDS = ("Carrier", "Origin", "Dest")
INTEGER_FIELDS = ("Month", "Hour")
DECIMAL_FIELDS = (
    "Temperature", "Wind_Speed", "Wind_Gust", "Precipitation", "Ice_Accretion_3hr",
)
# Numbers that only some models ask for.
EXTRA_FIELDS = ("Visibility",)

REQUEST = T.StructType(
    [T.StructField("request_id", _S)]
    + [T.StructField(n, _S) for n in CATEGORY_FIELDS]
    + [T.StructField(n, _I) for n in INTEGER_FIELDS]
    + [T.StructField(n, _D) for n in DECIMAL_FIELDS]
)

# Wire form: numbers arrive both bare and quoted, so every field is read as text.
RAW_REQUEST = T.StructType([T.StructField(f.name, _S) for f in REQUEST])

RESPONSE = T.StructType(
    [
        T.StructField("request_id", _S),
        T.StructField("probability", _D),
        T.StructField("risk", _S),
    ]
)

VOCABULARY = T.StructType(
    [T.StructField(n, T.ArrayType(_S)) for n in VOCABULARY_FIELDS]
)

# A topic message as files keep it; the same columns a broker source gives.
MESSAGE = T.StructType(
    [T.StructField("value", _S), T.StructField("timestamp", T.TimestampType())]
)
