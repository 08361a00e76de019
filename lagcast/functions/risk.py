"""Probabilities, risk bands and verdict texts as column expressions."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from lagcast import fixed


def delay_probability(vector: str | Column = "probability") -> Column:
    """Probability of the positive class out of a class-probability vector."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return vector_to_array(column)[1]


def risk_band(probability: Column, scheme: str = "service") -> Column:
    """Band of a probability: cuts are exclusive, so a value on one is below it."""
    cuts, rest = fixed.RISK_BANDS[scheme]
    band = F.lit(rest)
    for bound, name in reversed(cuts):
        band = F.when(probability > F.lit(bound), F.lit(name)).otherwise(band)
    return F.when(probability.isNotNull(), band)


def percent(probability: Column, decimals: int = 2) -> Column:
    """``0.1234`` as ``12.34%``."""
    return F.format_string(f"%.{decimals}f%%", probability.cast("double") * F.lit(100.0))


def verdict(probability: Column, scheme: str, carrier="Carrier", origin="Origin", dest="Dest") -> Column:
    """Sentence shown to the requester of a single prediction."""
    share = probability.cast("double") * F.lit(100.0)
    band = risk_band(probability, scheme)
    texts = {
        "alert": lambda: F.when(
            band == "AT_RISK", F.format_string(fixed.ALERT_AT_RISK_TEXT, share)
        ).otherwise(F.format_string(fixed.ALERT_ON_PLAN_TEXT, share)),
        "three": lambda: F.format_string(
            fixed.THREE_TEXT, band, share, F.col(carrier), F.col(origin)
        ),
        "extreme": lambda: F.format_string(
            fixed.EXTREME_TEXT, band, share, F.col(origin), F.col(dest), F.col(carrier)
        ),
        "service": lambda: F.format_string(
            fixed.SERVICE_TEXT,
            F.when(band == "High", fixed.SERVICE_NAMES["High"]).otherwise(fixed.SERVICE_NAMES["Low"]),
            percent(probability),
        ),
    }
    return F.when(probability.isNotNull(), texts[scheme]())
