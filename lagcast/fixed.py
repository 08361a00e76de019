"""Fixed values.

Everything in this module is data, not logic: column names, feature orders,
hyper-parameters, thresholds, input ranges, texts and topic names that must
equal those of the system whose results this library reproduces. They are
stated as they are, in natural order.
"""

# --- cleaning and labelling -------------------------------------------------

DELAY_THRESHOLD_MINUTES = 15
FILLED_COLUMNS = ("Wind_Gust", "Ice_Accretion_3hr")

COLUMN_SETS = {
    "V1": (
        "DepDelayMinutes", "Time", "Origin", "Temperature", "Wind_Speed",
        "Precipitation", "Visibility", "Wind_Gust", "Ice_Accretion_3hr",
    ),
    "V2": (
        "DepDelayMinutes", "Time", "Origin", "Carrier", "Temperature",
        "Wind_Speed", "Precipitation", "Wind_Gust", "Ice_Accretion_3hr",
    ),
    "V3": (
        "DepDelayMinutes", "Time", "Origin", "Dest", "Carrier", "Temperature",
        "Wind_Speed", "Precipitation", "Wind_Gust", "Ice_Accretion_3hr",
    ),
}

# --- feature vectors: order is part of the result ---------------------------

LAYOUTS = {
    "L1": (
        "OriginVec", "Month", "Hour", "Temperature", "Wind_Speed", "Wind_Gust",
        "Precipitation", "Visibility", "Ice_Accretion_3hr",
    ),
    "L2": (
        "OriginIndex", "CarrierIndex", "Month", "Hour", "Temperature",
        "Wind_Speed", "Wind_Gust", "Precipitation", "Ice_Accretion_3hr",
    ),
    "L3": (
        "OriginIndex", "DestIndex", "CarrierIndex", "Month", "Hour",
        "Temperature", "Wind_Speed", "Wind_Gust", "Precipitation",
        "Ice_Accretion_3hr",
    ),
}

# --- training ---------------------------------------------------------------

SPLIT_RATIO = 0.8
SPLIT_SEED = 42

FOREST_DEPTH = 10
FOREST_BINS = 64
FOREST_TREES = {"baseline": 40, "carrier": 50}

BOOSTED_DEPTH = 5
BOOSTED_BINS = 500
BOOSTED_ROUNDS = {"route": 30, "balanced": 30, "service": 20}

# The recorded score of the unweighted boosted model, to which later runs compare.
RECORDED_AUC = 0.7048

# --- risk bands: (strictly greater than, band), highest first, then the rest -

RISK_BANDS = {
    "alert": (((0.5, "AT_RISK"),), "ON_PLAN"),
    "three": (((0.6, "WYSOKIE"), (0.4, "ŚREDNIE")), "NISKIE"),
    "extreme": (((0.7, "EKSTREMALNE"), (0.5, "WYSOKIE")), "NISKIE"),
    "service": (((0.5, "High"),), "Low"),
}

ALERT_AT_RISK_TEXT = (
    "⚠️ RYZYKO OPÓŹNIENIA! (Prawdopodobieństwo: %.1f%%)\n"
    "Przyczyną mogą być porywy wiatru lub lód."
)
ALERT_ON_PLAN_TEXT = "✅ LOT PLANOWY (Ryzyko: %.1f%%)"
THREE_TEXT = "Ryzyko opóźnienia: %s (%.1f%%)\nAnaliza dla linii %s z lotniska %s."
EXTREME_TEXT = "Ryzyko: %s (%.1f%%)\nTrasa: %s -> %s linią %s."
SERVICE_TEXT = "Ryzyko: %s\nPrawdopodobieństwo opóźnienia: %s"
SERVICE_NAMES = {"High": "WYSOKIE ⚠️", "Low": "NISKIE ✅"}
ERROR_TEXT = "Błąd: %s"

# --- requests ---------------------------------------------------------------

REQUEST_TOPIC = "predict_requests"
RESPONSE_TOPIC = "predict_responses"
RESPONSE_TIMEOUT = "10 seconds"
TIMEOUT_TEXT = "Timeout - Spark nie odpowiedział na czas"

REQUEST_DEFAULTS = {
    "Month": "1",
    "Hour": "12",
    "Temperature": "70",
    "Wind_Speed": "10",
    "Wind_Gust": "0",
    "Precipitation": "0",
    "Ice_Accretion_3hr": "0",
}

INPUT_RANGES = {
    "baseline": {
        "Month": (1, 12), "Hour": (0, 23), "Temperature": (-10, 100),
        "Wind_Speed": (0, 50), "Wind_Gust": (0, 80), "Precipitation": (0, 5),
        "Visibility": (0, 10), "Ice_Accretion_3hr": (0, 5),
    },
    "carrier": {
        "Month": (1, 12), "Hour": (0, 23), "Temperature": (-10, 100),
        "Wind_Speed": (0, 40), "Wind_Gust": (0, 60), "Precipitation": (0, 2),
        "Ice_Accretion_3hr": (0, 5),
    },
    "route": {
        "Month": (1, 12), "Hour": (0, 23), "Temperature": (-10, 100),
        "Wind_Speed": (0, 40), "Wind_Gust": (0, 60), "Precipitation": (0, 2),
        "Ice_Accretion_3hr": (0, 5),
    },
}

# --- vocabularies: name in the stored object -> category column --------------

VOCABULARY_FIELDS = {"origins": "Origin", "dests": "Dest", "carriers": "Carrier"}
