"""The same results as plain SQL over the same tables, for another engine."""

from lagcast import fixed

# The flights table, as the Spark side derives it from events.
FLIGHTS = """
flights AS (
  SELECT event_id,
    value / 10e0 + hour(ts) * 5e-1 AS DepDelayMinutes,
    ts + to_days(CAST(30 * (user_id % 12) AS INT)) AS Time,
    event_type AS Origin,
    concat('D', CAST(user_id AS VARCHAR)) AS Dest,
    concat('C', CAST(k % 17 AS VARCHAR)) AS Carrier,
    CASE WHEN k <> 13 THEN CAST(k AS DOUBLE) END AS Temperature,
    CAST((k * 7) % 41 AS DOUBLE) AS Wind_Speed,
    CAST(k % 5 AS DOUBLE) / 10e0 AS Precipitation,
    CAST(k % 11 AS DOUBLE) AS Visibility,
    CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) / 2e0 END AS Wind_Gust,
    CASE WHEN k % 10 = 0 THEN CAST(k AS DOUBLE) / 50e0 END AS Ice_Accretion_3hr
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e
)"""


def _columns(version: str) -> str:
    return ", ".join(fixed.COLUMN_SETS[version])


def _filled(version: str) -> str:
    return ", ".join(
        f"coalesce({c}, 0e0) AS {c}" if c in fixed.FILLED_COLUMNS else c
        for c in fixed.COLUMN_SETS[version]
    )


def _present(columns) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


LABEL = "CASE WHEN DepDelayMinutes > 15 THEN 1e0 ELSE 0e0 END"


def _prepared(version: str = "V3", name: str = "prepared") -> str:
    needed = [c for c in fixed.COLUMN_SETS[version] if c not in fixed.FILLED_COLUMNS]
    return f"""
{name} AS (
  SELECT event_id, {_filled(version)}, {LABEL} AS Label,
    CAST(month(Time) AS INT) AS Month, CAST(hour(Time) AS INT) AS Hour
  FROM flights WHERE {_present(needed)}
)"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select.strip()


def on_flights(select: str) -> str:
    return _with(FLIGHTS, select=select)


def on_prepared(select: str, *more: str, version: str = "V3") -> str:
    return _with(FLIGHTS, _prepared(version), *more, select=select)


TOXIC = """
toxic AS (
  SELECT doc_id, CAST(toxic AS DOUBLE) AS Label, n_chars AS score
  FROM labels JOIN documents USING (doc_id)
)"""


def _union_kinds(select: str) -> str:
    return " UNION ALL ".join(select.format(kind=k) for k in ("Origin", "Dest", "Carrier"))


def _ranked(source: str, name: str = "ranked") -> str:
    counted = "SELECT '{kind}' AS kind, {kind} AS label, count(*) AS n FROM " + source + " GROUP BY {kind}"
    return f"""
{name} AS (
  SELECT kind, label, n,
    row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) - 1 AS idx
  FROM ({_union_kinds(counted)}) c
)"""


HASHED = "CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100"
TRAINING = f"{HASHED} < 80"

# --- requests -------------------------------------------------------------------

_WIRE = """
wire AS (
  SELECT event_id, event_id % 10 AS m,
    concat('r', CAST(event_id AS VARCHAR)) AS request_id, Carrier, Origin, Dest,
    CASE event_id % 10 WHEN 1 THEN 'x' WHEN 5 THEN '5.7'
      ELSE CAST(month(Time) AS VARCHAR) END AS Month,
    CASE WHEN event_id % 10 <> 2 THEN CAST(hour(Time) AS VARCHAR) END AS Hour,
    CASE WHEN event_id % 10 = 3 THEN 'nan' ELSE CAST(Temperature AS VARCHAR) END AS Temperature,
    CAST(Wind_Speed AS VARCHAR) AS Wind_Speed,
    CAST(coalesce(Wind_Gust, 0e0) AS VARCHAR) AS Wind_Gust,
    CAST(Precipitation AS VARCHAR) AS Precipitation,
    CAST(coalesce(Ice_Accretion_3hr, 0e0) AS VARCHAR) AS Ice_Accretion_3hr
  FROM flights
)"""

_FIELDS = (
    "request_id", "Carrier", "Origin", "Dest", "Month", "Hour", "Temperature",
    "Wind_Speed", "Wind_Gust", "Precipitation", "Ice_Accretion_3hr",
)
_NUMBERS = _FIELDS[4:]

# A message cut short has no readable field.
_PARSED = (
    "\nparsed AS (SELECT event_id, "
    + ", ".join(f"CASE WHEN m <> 0 THEN {c} END AS {c}" for c in _FIELDS)
    + " FROM wire)"
)


def _number(column: str) -> str:
    if column in ("Month", "Hour"):
        return f"CASE WHEN regexp_matches({column}, '^[0-9]+$') THEN CAST({column} AS INT) END"
    return f"CASE WHEN {column} <> 'nan' THEN CAST({column} AS DOUBLE) END"


_ERRORS = ", ".join(
    [f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in _FIELDS[:4]]
    + [
        f"CASE WHEN {c} IS NULL THEN 'missing {c}' WHEN {_number(c)} IS NULL THEN 'bad {c}' END"
        for c in _NUMBERS
    ]
)

_COERCED = (
    "\ncoerced AS (SELECT "
    + ", ".join(_FIELDS[:4])
    + ", "
    + ", ".join(f"{_number(c)} AS {c}" for c in _NUMBERS)
    + f", nullif(concat_ws(', ', {_ERRORS}), '') AS error FROM parsed)"
)


def on_requests(select: str, *more: str) -> str:
    return _with(FLIGHTS, _WIRE, _PARSED, _COERCED, *more, select=select)


# --- correlation ------------------------------------------------------------------


# Requests, and the answers sent to them.
_SENT = """
WITH e AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 50 <> 1 THEN concat('r', event_id) END AS request_id,
    event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), first_sent AS (
  SELECT request_id, ts, k,
    CASE WHEN k % 10 < 6 THEN 3 WHEN k % 10 < 8 THEN 20 WHEN k % 10 = 8 THEN 10 END AS wait
  FROM e
), sent AS (
  SELECT request_id, ts + to_seconds(unnest(
      CASE WHEN k % 3 = 0 THEN [wait, wait + 1, -3] ELSE [wait] END)) AS resp_ts,
    k / 100e0 AS probability, CASE WHEN k > 50 THEN 'High' ELSE 'Low' END AS risk
  FROM first_sent WHERE wait IS NOT NULL
)"""

# The first answer of an id from each request on, if it comes within ten seconds.
_CORRELATED = f"""{_SENT}, met AS (
  SELECT e.event_id, min({{'at': s.resp_ts, 'p': s.probability, 'r': s.risk}}) AS answer
  FROM e JOIN sent s
    ON s.request_id = e.request_id AND s.resp_ts >= e.ts AND s.resp_ts <= e.ts + INTERVAL 10 SECONDS
  GROUP BY e.event_id
)
SELECT e.request_id, e.ts AS req_ts, answer.at AS resp_ts, answer.p AS probability, answer.r AS risk,
  CASE WHEN answer IS NULL THEN '{fixed.TIMEOUT_TEXT}' END AS error
FROM e LEFT JOIN met USING (event_id)"""


# --- probability ------------------------------------------------------------------

P = "CAST(Hour % 11 AS DOUBLE) / 10e0"


def _band(scheme: str, p: str = P) -> str:
    cuts, rest = fixed.RISK_BANDS[scheme]
    whens = " ".join(f"WHEN {p} > {bound}e0 THEN '{name}'" for bound, name in cuts)
    return f"CASE {whens} ELSE '{rest}' END"


_ONE_DECIMAL = f"printf('%.1f%%', {P} * 100e0)"
_TWO_DECIMALS = f"printf('%.2f%%', {P} * 100e0)"

_VERDICTS = {
    "alert": f"""CASE WHEN {P} > 5e-1
      THEN concat('⚠️ RYZYKO OPÓŹNIENIA! (Prawdopodobieństwo: ', {_ONE_DECIMAL}, ')', chr(10),
                  'Przyczyną mogą być porywy wiatru lub lód.')
      ELSE concat('✅ LOT PLANOWY (Ryzyko: ', {_ONE_DECIMAL}, ')') END""",
    "three": f"""concat('Ryzyko opóźnienia: ', {_band("three")}, ' (', {_ONE_DECIMAL}, ')', chr(10),
      'Analiza dla linii ', Carrier, ' z lotniska ', Origin, '.')""",
    "extreme": f"""concat('Ryzyko: ', {_band("extreme")}, ' (', {_ONE_DECIMAL}, ')', chr(10),
      'Trasa: ', Origin, ' -> ', Dest, ' linią ', Carrier, '.')""",
    "service": f"""concat('Ryzyko: ', CASE WHEN {P} > 5e-1 THEN 'WYSOKIE ⚠️' ELSE 'NISKIE ✅' END,
      chr(10), 'Prawdopodobieństwo opóźnienia: ', {_TWO_DECIMALS})""",
}

# --- quality ----------------------------------------------------------------------


def _auc(source: str, score: str, name: str = "a") -> str:
    return f"""
{name}_by_score AS (
  SELECT {score} AS s, count(*) FILTER (WHERE Label > 0.5) AS p,
    count(*) FILTER (WHERE Label <= 0.5) AS n
  FROM {source} GROUP BY {score}
), {name}_ranked AS (
  SELECT p, n, coalesce(sum(n) OVER (
    ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM {name}_by_score
), {name} AS (
  SELECT round(CAST(sum(CAST(p AS HUGEINT) * (2 * below + n)) AS DOUBLE)
      / (2e0 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 9) AS auc,
    CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives
  FROM {name}_ranked
)"""


def _holdout(version: str, select: str) -> str:
    return on_prepared(f"{select} FROM prepared WHERE NOT ({TRAINING})", version=version)


_RISK = """count(*) AS flights, count(*) FILTER (WHERE Label = 1e0) AS delayed,
  CAST(count(*) FILTER (WHERE Label = 1e0) AS DOUBLE) / count(*) AS risk"""

_WIDE = """SELECT count(*) AS total, count(*) FILTER (WHERE Label = 1e0) AS delayed,
  count(*) FILTER (WHERE Label = 0e0) AS on_time FROM {source}"""


def _balanced(source: str, condition: str = "TRUE") -> str:
    return f"""
SELECT v.Label, count(p.Label) AS count,
  CASE WHEN count(p.Label) > 0 THEN
    CAST((SELECT count(*) FROM {source} WHERE {condition}) AS DOUBLE) / (2 * count(p.Label)) END
    AS class_weight
FROM (VALUES (0e0), (1e0)) v(Label)
LEFT JOIN (SELECT Label FROM {source} WHERE {condition}) p ON p.Label = v.Label
GROUP BY v.Label"""


def _proportions(source: str) -> str:
    return f"""
SELECT Label, count(*) AS count,
  CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {source}) AS Proportion
FROM {source} GROUP BY Label"""


_INDEX_JOIN = """
LEFT JOIN (SELECT * FROM ranked WHERE kind = '{kind}') r_{kind} ON r_{kind}.label = p.{kind}"""
_INDEX = """CAST(coalesce(r_{kind}.idx, (SELECT count(*) FROM ranked WHERE kind = '{kind}'))
  AS DOUBLE)"""


def _indexed(kinds: tuple[str, ...], alias: str = "{kind}Index") -> tuple[str, str]:
    shown = ", ".join(f"{_INDEX.format(kind=k)} AS {alias.format(kind=k)}" for k in kinds)
    return shown, "".join(_INDEX_JOIN.format(kind=k) for k in kinds)


def _index_query(kinds: tuple[str, ...], fitted_on: str, shown_on: str = "prepared") -> str:
    shown, joins = _indexed(kinds)
    return on_prepared(
        f"SELECT event_id, {', '.join('p.' + k for k in kinds)}, {shown} FROM {shown_on} p {joins}",
        f"\ntraining AS (SELECT * FROM prepared WHERE {TRAINING})",
        _ranked(fitted_on),
    )


def _assembled(version: str, layout: str, kinds: tuple[str, ...]) -> str:
    _, joins = _indexed(kinds)
    inputs = [
        _INDEX.format(kind=c.removesuffix("Index")) if c.endswith("Index") else f"CAST(p.{c} AS DOUBLE)"
        for c in fixed.LAYOUTS[layout]
    ]
    shown = ", ".join(f"{value} AS f{i}" for i, value in enumerate(inputs))
    counted = "SELECT '{kind}' AS kind, {kind} AS label, count(*) AS n FROM prepared GROUP BY {kind}"
    ranked = f"""
ranked AS (
  SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) - 1 AS idx
  FROM ({' UNION ALL '.join(counted.format(kind=k) for k in kinds)}) c
)"""
    return on_prepared(f"SELECT event_id, {shown} FROM prepared p {joins}", ranked, version=version)


_L1_NUMBERS = ", ".join(
    f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(fixed.LAYOUTS["L1"][1:])
)

_LACKING = (
    "\nlacking AS (SELECT request_id, "
    + ", ".join(
        f"CASE WHEN event_id % 7 <> {at} THEN {c} END AS {c}"
        for c, at in (("Carrier", 0), ("Origin", 1), ("Dest", 2), ("Month", 3),
                      ("Temperature", 4), ("Wind_Speed", 5))
    )
    + ", Hour, Wind_Gust, Precipitation, Ice_Accretion_3hr FROM wire)"
)

_DEFAULTED = ", ".join(
    [f"coalesce({c}, (SELECT min({c}) FROM prepared)) AS {c}" for c in ("Carrier", "Origin", "Dest")]
    + [f"coalesce({c}, '{v}') AS {c}" for c, v in fixed.REQUEST_DEFAULTS.items()]
)

def _in_ranges(name: str) -> str:
    return " AND ".join(
        f"{c} BETWEEN {low} AND {high}" for c, (low, high) in fixed.INPUT_RANGES[name].items()
    )


_IN_RANGES = _in_ranges("route")

_KNOWN = " AND ".join(
    f"{c} IN (SELECT {c} FROM prepared WHERE {TRAINING})"
    for c in ("Carrier", "Origin", "Dest")
)

ORACLE = {
    # scans, sources, sinks
    "flights_csv_scan": on_flights(f"SELECT {_columns('V3')}, Visibility FROM flights"),
    "flights_csv_by_name": on_flights(f"SELECT {_columns('V3')}, Visibility FROM flights"),
    "inferred_by_name": on_flights(f"SELECT {_columns('V3')}, Visibility FROM flights"),
    "inferred_schema": f"""
SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string'
  ELSE lower(column_type) END AS type, TRUE AS nullable
FROM (DESCRIBE {on_flights(f"SELECT {_columns('V3')}, Visibility FROM flights")})""",
    "request_frame": _with(
        FLIGHTS, _WIRE,
        select="SELECT "
        + ", ".join("CAST(NULL AS VARCHAR) AS Dest" if c == "Dest" else c for c in _FIELDS)
        + " FROM wire",
    ),
    "model_reload": on_prepared("SELECT event_id, TRUE AS same FROM prepared"),
    "stored_vocabulary": on_prepared(
        _union_kinds("SELECT DISTINCT '{kind}' AS kind, {kind} AS label FROM prepared")
    ),
    "request_topic": _with(FLIGHTS, _WIRE, select=f"SELECT {', '.join(_FIELDS)} FROM wire"),
    "newest_requests": "SELECT concat('r', event_id) AS sent_id, TRUE AS ids_differ FROM events WHERE event_id % 3 <> 0",
    "response_topic": f"{_SENT} SELECT request_id, probability, risk FROM sent",
    # cleaning and labelling
    "prepared_v1": on_prepared("SELECT * FROM prepared", version="V1"),
    "prepared_v2": on_prepared("SELECT * FROM prepared", version="V2"),
    "prepared_v3": on_prepared("SELECT * FROM prepared"),
    "selected_columns": on_flights(f"SELECT {_columns('V2')} FROM flights"),
    "filled_weather": on_flights(f"SELECT event_id, {_filled('V3')} FROM flights"),
    "complete_flights": on_flights(
        f"SELECT event_id, {_columns('V3')} FROM flights WHERE {_present(fixed.COLUMN_SETS['V3'])}"
    ),
    "labelled_flights": on_flights(f"SELECT event_id, DepDelayMinutes, {LABEL} AS Label FROM flights"),
    "time_parts": on_flights(
        "SELECT event_id, CAST(month(Time) AS INT) AS Month, CAST(hour(Time) AS INT) AS Hour FROM flights"
    ),
    "delayed_flights": on_prepared("SELECT * FROM prepared WHERE Label = 1e0"),
    "constant_column": on_flights("SELECT event_id, 1e0 AS unit FROM flights"),
    "peek_rows": on_prepared("SELECT count(*) AS shown, count(*) AS found FROM (SELECT * FROM prepared LIMIT 5) x"),
    # probability, bands, texts
    "probability_of_delay": on_prepared(f"SELECT event_id, {P} AS p FROM prepared"),
    "risk_bands": on_prepared(
        "SELECT event_id, " + ", ".join(f"{_band(s)} AS {s}" for s in fixed.RISK_BANDS) + " FROM prepared"
    ),
    "verdicts": on_prepared(
        "SELECT event_id, " + ", ".join(f"{t} AS {s}" for s, t in _VERDICTS.items()) + " FROM prepared"
    ),
    "percentages": on_prepared(f"SELECT event_id, {_TWO_DECIMALS} AS share FROM prepared"),
    # requests
    "parsed_requests": on_requests(f"SELECT {', '.join(_FIELDS)} FROM parsed"),
    "coerced_requests": on_requests(
        "SELECT * REPLACE (CAST(Month AS DOUBLE) AS Month, CAST(Hour AS DOUBLE) AS Hour) FROM coerced"
    ),
    "dead_letters": on_requests("SELECT request_id, error FROM coerced WHERE error IS NOT NULL"),
    "request_payloads": _with(
        FLIGHTS, _WIRE,
        select="SELECT request_id AS key, CAST(to_json({"
        + ", ".join(f"'{c}': {c}" for c in _FIELDS)
        + "}) AS VARCHAR) AS value FROM wire",
    ),
    "request_ids": "SELECT count(*) AS rows, count(*) AS ids, TRUE AS well_formed, TRUE AS same_again FROM events",
    "defaulted_requests": on_prepared(
        f"SELECT request_id, {_DEFAULTED} FROM lacking", _WIRE, _LACKING
    ),
    "valid_requests": on_requests(
        "SELECT * EXCLUDE (error) FROM (SELECT * REPLACE (CASE WHEN request_id LIKE '%7' THEN 'new ' || Carrier "
        f"ELSE Carrier END AS Carrier) FROM coerced) c WHERE error IS NULL AND {_IN_RANGES} AND {_KNOWN}",
        _prepared(),
    ),
    "valid_requests_carrier": on_requests(
        f"""SELECT * EXCLUDE (error) FROM coerced WHERE error IS NULL AND {_in_ranges("carrier")}
        AND Origin IN (SELECT Origin FROM prepared) AND Carrier IN (SELECT Carrier FROM prepared)""",
        _prepared(),
    ),
    # joins
    "correlated": _CORRELATED,
    # aggregations
    "row_count": on_prepared("SELECT count(*) AS rows FROM prepared"),
    "class_counts_wide": on_prepared(_WIDE.format(source="prepared")),
    "class_counts": on_prepared("SELECT Label, count(*) AS count FROM prepared GROUP BY Label"),
    "class_proportions": on_prepared(_proportions("prepared")),
    "balance_ratio": on_prepared(
        f"SELECT *, CASE WHEN delayed > 0 THEN CAST(on_time AS DOUBLE) / delayed END AS ratio "
        f"FROM ({_WIDE.format(source='prepared')}) w"
    ),
    "balanced_weights": on_prepared(_balanced("prepared")),
    "vocabularies": on_prepared(
        _union_kinds("SELECT DISTINCT '{kind}' AS kind, {kind} AS label FROM prepared")
    ),
    "frequency_indices": on_prepared(
        "SELECT kind, label, n AS count, idx AS index FROM ranked", _ranked("prepared")
    ),
    "toxic_class_proportions": _with(TOXIC, select=_proportions("toxic")),
    "toxic_weights": _with(TOXIC, select=_balanced("toxic")),
    # weights and splits
    "ratio_weighted": on_prepared(
        f"""SELECT event_id, Label, CASE WHEN Label = 1e0
          THEN (SELECT CAST(on_time AS DOUBLE) / delayed FROM ({_WIDE.format(source="prepared")}) w)
          ELSE 1e0 END AS classWeight FROM prepared"""
    ),
    "balanced_weighted": on_prepared(
        "SELECT event_id, Label, class_weight FROM prepared JOIN weights USING (Label)",
        f"\nweights AS ({_balanced('prepared')})",
    ),
    "hash_split": on_prepared(
        f"SELECT event_id, CASE WHEN {TRAINING} THEN 'train' ELSE 'test' END AS part FROM prepared"
    ),
    "random_split": on_prepared("SELECT count(*) AS rows, 0 AS in_both, TRUE AS share_kept FROM prepared"),
    "training_weights": on_prepared(_balanced("prepared", TRAINING)),
    # features
    "index_strict": _index_query(("Origin", "Carrier"), "prepared"),
    "index_keep": _index_query(
        ("Origin", "Dest", "Carrier"), "training",
        "(SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 'new ' || Origin ELSE Origin END AS Origin) FROM prepared)",
    ),
    "one_hot_origin": on_prepared(
        """SELECT event_id, p.Origin,
          concat(repeat('0', CAST(least(r.idx, width) AS BIGINT)),
                 CASE WHEN r.idx < width THEN '1' ELSE '' END,
                 repeat('0', CAST(width - least(r.idx, width) - 1 AS BIGINT))) AS indicators
        FROM prepared p JOIN ranked r ON r.kind = 'Origin' AND r.label = p.Origin,
          (SELECT count(*) - 1 AS width FROM ranked WHERE kind = 'Origin') w""",
        _ranked("prepared"),
    ),
    "assembled_l1": on_prepared(
        f"""SELECT event_id, CAST((SELECT count(DISTINCT Origin) FROM prepared) - 1 + 8 AS INT) AS width,
          {_L1_NUMBERS} FROM prepared""",
        version="V1",
    ),
    "assembled_l2": _assembled("V2", "L2", ("Origin", "Carrier")),
    "assembled_l3": _assembled("V3", "L3", ("Origin", "Dest", "Carrier")),
    # models
    "service_scores": on_prepared("SELECT event_id, TRUE AS logistic FROM prepared"),
    "auc_by_hour": on_prepared("SELECT * FROM a", _auc("prepared", "Hour")),
    "auc_by_carrier_rate": on_prepared(
        "SELECT * FROM a",
        "\nrates AS (SELECT Carrier, round(avg(Label), 6) AS rate FROM prepared GROUP BY Carrier)",
        "\nrated AS (SELECT Label, rate FROM prepared JOIN rates USING (Carrier))",
        _auc("rated", "rate"),
    ),
    "auc_many_scores": on_prepared(
        "SELECT * FROM a", _auc("prepared", "DepDelayMinutes + Wind_Speed * 2e0")
    ),
    "auc_toxic_by_length": _with(TOXIC, _auc("toxic", "score"), select="SELECT * FROM a"),
    "compared_runs": on_prepared(
        f"""SELECT 'hour' AS run, auc, round(auc - {fixed.RECORDED_AUC}e0, 9) AS delta FROM h
        UNION ALL SELECT 'wind', auc, round(auc - {fixed.RECORDED_AUC}e0, 9) FROM w""",
        _auc("prepared", "Hour", "h"),
        _auc("prepared", "Wind_Speed", "w"),
    ),
    "compared_models": "SELECT run, TRUE AS sound FROM (VALUES ('route'), ('balanced')) v(run)",
    "model_vocabularies": on_prepared(
        _union_kinds("SELECT DISTINCT '{kind}' AS kind, {kind} AS label FROM prepared")
    ),
    "predictions_with_errors": on_requests("SELECT request_id, error, TRUE AS sound FROM coerced"),
    # streams
    "stream_scoring": on_requests(
        "SELECT request_id, TRUE AS same_as_batch FROM coerced WHERE error IS NULL"
    ),
    "stream_dead_letters": on_requests(
        "SELECT request_id, error, TRUE AS same_again FROM coerced WHERE error IS NOT NULL"
    ),
    "stream_correlation": f"SELECT DISTINCT * FROM ({_CORRELATED}) WHERE request_id IS NOT NULL",
    # analyses
    "risk_by_time": on_prepared(f"SELECT Month, Hour, {_RISK} FROM prepared GROUP BY Month, Hour"),
    "risk_by_carrier": on_prepared(f"SELECT Carrier, {_RISK} FROM prepared GROUP BY Carrier"),
    "risk_by_route": on_prepared(f"SELECT Origin, Dest, {_RISK} FROM prepared GROUP BY Origin, Dest"),
    "risk_by_gust": on_prepared(
        f"""SELECT CAST(floor(Wind_Gust / 10) * 10 AS BIGINT) AS gust_from, {_RISK}
        FROM prepared GROUP BY CAST(floor(Wind_Gust / 10) * 10 AS BIGINT)"""
    ),
    "risk_by_icing": on_prepared(
        f"SELECT Ice_Accretion_3hr > 0 AS icing, {_RISK} FROM prepared GROUP BY Ice_Accretion_3hr > 0"
    ),
}

for _recipe, _version in (("baseline", "V1"), ("carrier", "V2"), ("route", "V3"), ("balanced", "V3")):
    ORACLE[f"holdout_{_recipe}"] = _holdout(_version, "SELECT event_id, Label, TRUE AS sound")
    ORACLE[f"auc_{_recipe}"] = _holdout(
        _version,
        "SELECT TRUE AS agrees, TRUE AS informative, count(*) FILTER (WHERE Label = 1e0) AS positives, "
        "count(*) FILTER (WHERE Label = 0e0) AS negatives",
    )

# Names of the features; with one-hot categories, one for every label but the rarest.
_NUMBERED = "SELECT CAST(position AS INT) AS position, name, TRUE AS sound FROM (VALUES {rows}) v(position, name)"
for _recipe, _layout in (("carrier", "L2"), ("route", "L3"), ("balanced", "L3")):
    ORACLE[f"importances_{_recipe}"] = _NUMBERED.format(
        rows=", ".join(f"({i}, '{c}')" for i, c in enumerate(fixed.LAYOUTS[_layout]))
    )
ORACLE["importances_baseline"] = on_prepared(
    f"""SELECT CAST(idx AS INT) AS position, 'OriginVec_' || label AS name, TRUE AS sound
    FROM ranked WHERE kind = 'Origin' AND idx < (SELECT max(idx) FROM ranked WHERE kind = 'Origin')
    UNION ALL
    SELECT CAST((SELECT max(idx) FROM ranked WHERE kind = 'Origin') + position AS INT), name, TRUE
    FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(fixed.LAYOUTS["L1"][1:]))}) v(position, name)""",
    f"""\nranked AS (SELECT 'Origin' AS kind, label, row_number() OVER (ORDER BY n DESC, label) - 1 AS idx
    FROM (SELECT Origin AS label, count(*) AS n FROM prepared WHERE {TRAINING} GROUP BY Origin) c)""",
    version="V1",
)
