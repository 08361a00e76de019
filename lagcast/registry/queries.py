"""The registered queries: each runs one operator over whole test tables."""

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import fixed
from lagcast.functions.codec import decode
from lagcast.functions.once import with_fields
from lagcast.functions.risk import delay_probability, percent, risk_band, verdict
from lagcast.operators import classes, metrics, prepare as prep, profile
from lagcast.operators.correlate import correlate
from lagcast.operators.features import assemble, index, model_vocabulary, one_hot
from lagcast.operators.requests import (
    coerce_request, split_bad, valid_request, with_request_defaults, with_request_id,
)
from lagcast.operators.split import split
from lagcast.operators.trees import score
from lagcast.operators.vocabulary import frequency_index, vocabulary
from lagcast.plans.predicting import predict, respond
from lagcast.registry.inputs import (
    KEY, answered, asked, experiment, flights, lacking_requests, prepared, request_messages,
    service_model, table, tenth, toxic_documents, training, wire_requests,
)
from lagcast.schemas import MESSAGE, RAW_REQUEST
from lagcast.session import scratch_path, settled
from lagcast.sources.flights import read_flights, schema_report
from lagcast.sources.models import load_model, save_model
from lagcast.sources.requests import requests_df
from lagcast.sources.topics import (
    PLACE, file_topic, log_topic, messages, parse_requests, request_stream, response_stream, to_payload,
    write_requests, write_responses,
)
from lagcast.sources.vocabularies import read_vocab, vocabulary_labels, write_vocab
from lagcast.streaming.matching import correlate_stream
from lagcast.streaming.serving import serve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COLUMNS = list(fixed.COLUMN_SETS["V3"])


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- scans, sources, sinks ----------------------------------------------------


def _as_csv(spark: SparkSession, folder: str, swapped: bool = False) -> str:
    """The flights as CSV files in nested folders, a part of them with the columns in another order."""
    path = scratch_path(spark, "flights-csv")
    rows = flights(spark, folder).drop(KEY)
    for part, branch in zip(split(rows), ("one", "two/deep")):
        names = reversed(rows.columns) if swapped and branch == "one" else rows.columns
        part.select(*names).write.option("header", "true").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
        ).csv(f"{path}/{branch}")
    return path


@query
def flights_csv_scan(spark, folder):
    return read_flights(spark, _as_csv(spark, folder))


@query
def inferred_schema(spark, folder):
    return schema_report(read_flights(spark, _as_csv(spark, folder), infer=True))


@query
def flights_csv_by_name(spark, folder):
    return read_flights(spark, _as_csv(spark, folder, swapped=True), by_name=True)


@query
def inferred_by_name(spark, folder):
    read = read_flights(spark, _as_csv(spark, folder, swapped=True), infer=True)
    return read.withColumn("Time", F.col("Time").cast("timestamp_ntz"))


@query
def request_frame(spark, folder):
    return requests_df(spark, wire_requests(spark, folder).drop("Dest"))


@query
def model_reload(spark, folder):
    model, path = service_model(spark, folder), scratch_path(spark, "model")
    save_model(model, path)
    rows = prepared(spark, folder)
    before = score(model, rows).select(KEY, delay_probability().alias("before"))
    after = score(load_model(path), rows).select(KEY, delay_probability().alias("after"))
    return before.join(after, KEY).select(KEY, (F.col("before") == F.col("after")).alias("same"))


@query
def stored_vocabulary(spark, folder):
    path = scratch_path(spark, "vocabulary")
    write_vocab(vocabulary(prepared(spark, folder)), path)
    return vocabulary_labels(read_vocab(spark, path))


def _put(df: DataFrame, path: str) -> str:
    """Messages into a folder that stands for a topic."""
    topic = file_topic(path)
    messages_only = df.select(*MESSAGE.names)
    messages_only.write.format(topic.format).options(**topic.options).mode("append").save(path)
    return path


def _drain(df: DataFrame, schema, spark: SparkSession, out: str | None = None, progress: str | None = None) -> DataFrame:
    """Run a stream over what its source holds, and read what it wrote."""
    out = out or scratch_path(spark, "out")
    running = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", progress or scratch_path(spark, "progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    running.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query
def request_topic(spark, folder):
    topic = file_topic(scratch_path(spark, "requests"))
    write_requests(wire_requests(spark, folder), topic)
    read = request_stream(spark, topic).select(*RAW_REQUEST.names)
    return _drain(read, RAW_REQUEST, spark)


@query
def newest_requests(spark, folder):
    """Requests of a log that came after the first start, over two restarts."""
    topic = log_topic(scratch_path(spark, "log"))
    out, progress = scratch_path(spark, "out"), scratch_path(spark, "progress")
    for part in range(3):
        write_requests(wire_requests(spark, folder).where(F.col(KEY) % 3 == part), topic)
        read = request_stream(spark, topic)
        read = with_request_id(read.withColumnRenamed("request_id", "sent_id"), *PLACE).select("sent_id", "request_id")
        _drain(read, read.schema, spark, out, progress)
    kept = spark.read.schema(read.schema).parquet(out)
    ids = kept.agg(F.countDistinct("request_id")).scalar()
    return kept.select("sent_id", (ids == kept.agg(F.count(F.lit(1))).scalar()).alias("ids_differ"))


@query
def response_topic(spark, folder):
    topic = file_topic(scratch_path(spark, "responses"))
    write_responses(answered(spark, folder), topic)
    read = response_stream(spark, topic).select("request_id", "probability", "risk")
    return _drain(read, read.schema, spark)


# --- cleaning and labelling ---------------------------------------------------


@query
def prepared_v1(spark, folder):
    return prepared(spark, folder, "V1")


@query
def prepared_v2(spark, folder):
    return prepared(spark, folder, "V2")


@query
def prepared_v3(spark, folder):
    return prepared(spark, folder, "V3")


@query
def selected_columns(spark, folder):
    return prep.select_features(flights(spark, folder), "V2")


@query
def filled_weather(spark, folder):
    return prep.fill_weather(prep.select_features(flights(spark, folder), "V3", (KEY,)))


@query
def complete_flights(spark, folder):
    return prep.drop_incomplete(prep.select_features(flights(spark, folder), "V3", (KEY,)))


@query
def labelled_flights(spark, folder):
    return prep.with_label(flights(spark, folder)).select(KEY, "DepDelayMinutes", "Label")


@query
def time_parts(spark, folder):
    return prep.with_time_parts(flights(spark, folder)).select(KEY, "Month", "Hour")


@query
def delayed_flights(spark, folder):
    return prep.filter_class(prepared(spark, folder), 1.0)


@query
def constant_column(spark, folder):
    return prep.with_constant(flights(spark, folder).select(KEY), "unit", 1.0)


@query
def peek_rows(spark, folder):
    rows = prepared(spark, folder)
    shown = prep.peek(rows)
    found = shown.intersect(rows).agg(F.count(F.lit(1)).alias("found")).scalar()
    return shown.agg(F.count(F.lit(1)).alias("shown")).withColumn("found", found)


# --- probability, bands, texts ------------------------------------------------


@query
def probability_of_delay(spark, folder):
    vector = array_to_vector(F.array(F.lit(1.0) - tenth(), tenth()))
    return prepared(spark, folder).select(KEY, delay_probability(vector).alias("p"))


@query
def risk_bands(spark, folder):
    return prepared(spark, folder).select(
        KEY, *[risk_band(tenth(), scheme).alias(scheme) for scheme in fixed.RISK_BANDS]
    )


@query
def verdicts(spark, folder):
    return prepared(spark, folder).select(
        KEY, *[verdict(tenth(), scheme).alias(scheme) for scheme in fixed.RISK_BANDS]
    )


@query
def percentages(spark, folder):
    return prepared(spark, folder).select(KEY, percent(tenth()).alias("share"))


# --- requests -----------------------------------------------------------------


@query
def parsed_requests(spark, folder):
    return parse_requests(request_messages(spark, folder)).select(*RAW_REQUEST.names)


def _coerced(spark, folder):
    return coerce_request(parse_requests(request_messages(spark, folder)))


@query
def coerced_requests(spark, folder):
    # Whole numbers with gaps read back differently from engine to engine.
    shown = {c: F.col(c).cast("double") for c in ("Month", "Hour")}
    return _coerced(spark, folder).drop("payload", "req_ts").withColumns(shown)


@query
def dead_letters(spark, folder):
    return split_bad(_coerced(spark, folder))[1].select("request_id", "error")


@query
def request_payloads(spark, folder):
    return to_payload(wire_requests(spark, folder), RAW_REQUEST.names)


@query
def request_ids(spark, folder):
    """Ids from the rows' places, drawn twice: once as the table lies, once shuffled and settled."""
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    rows = table(spark, folder, "events").select(KEY, *place)
    once = with_request_id(rows, "path", "row").select(KEY, "request_id")
    again = with_request_id(settled(rows.repartition(5)), "path", "row").select(KEY, F.col("request_id").alias("again"))
    uuid = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return once.join(again, KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("request_id").alias("ids"),
        F.bool_and(F.col("request_id").rlike(uuid)).alias("well_formed"),
        F.bool_and(F.col("request_id") == F.col("again")).alias("same_again"),
    )


@query
def defaulted_requests(spark, folder):
    return with_request_defaults(
        lacking_requests(spark, folder), vocabulary(prepared(spark, folder))
    )


@query
def valid_requests(spark, folder):
    good, _ = split_bad(_coerced(spark, folder))
    # Some carriers have a name that training has not seen.
    carrier = F.when(F.col("request_id").endswith("7"), F.concat(F.lit("new "), "Carrier"))
    asks = good.withColumn("Carrier", F.coalesce(carrier, "Carrier"))
    return valid_request(asks.select(*RAW_REQUEST.names), vocabulary(training(spark, folder)))


# --- joins --------------------------------------------------------------------


@query
def correlated(spark, folder):
    return correlate(asked(spark, folder), answered(spark, folder))


# --- aggregations -------------------------------------------------------------


@query
def row_count(spark, folder):
    return classes.row_count(prepared(spark, folder))


@query
def class_counts_wide(spark, folder):
    return classes.class_counts_wide(prepared(spark, folder))


@query
def class_counts(spark, folder):
    return classes.class_counts(prepared(spark, folder))


@query
def class_proportions(spark, folder):
    return classes.class_proportions(prepared(spark, folder))


@query
def balance_ratio(spark, folder):
    return classes.balance_ratio(prepared(spark, folder))


@query
def balanced_weights(spark, folder):
    return classes.balanced_weights(prepared(spark, folder))


@query
def vocabularies(spark, folder):
    return vocabulary(prepared(spark, folder))


@query
def frequency_indices(spark, folder):
    return frequency_index(prepared(spark, folder), "Origin", "Dest", "Carrier")


@query
def toxic_class_proportions(spark, folder):
    return classes.class_proportions(toxic_documents(spark, folder))


@query
def toxic_weights(spark, folder):
    return classes.balanced_weights(toxic_documents(spark, folder))


# --- weights and splits -------------------------------------------------------


@query
def ratio_weighted(spark, folder):
    return classes.with_ratio_weight(prepared(spark, folder)).select(KEY, "Label", "classWeight")


@query
def balanced_weighted(spark, folder):
    return classes.with_balanced_weight(prepared(spark, folder)).select(KEY, "Label", "class_weight")


@query
def hash_split(spark, folder):
    train, test = split(prepared(spark, folder), KEY)
    return train.select(KEY, F.lit("train").alias("part")).unionByName(
        test.select(KEY, F.lit("test").alias("part"))
    )


@query
def random_split(spark, folder):
    train, test = split(prepared(spark, folder), mode="random")
    parts = train.select(KEY, F.lit(1).alias("train")).unionByName(test.select(KEY, F.lit(0).alias("train")))
    placed = parts.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("train").alias("train"))
    share = F.abs(F.sum("train") / F.count(F.lit(1)) - 0.8) < 0.05
    return placed.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).cast("int").alias("in_both"), share.alias("share_kept")
    )


@query
def training_weights(spark, folder):
    return classes.balanced_weights(split(prepared(spark, folder), KEY)[0])


# --- features -----------------------------------------------------------------


@query
def index_strict(spark, folder):
    rows = prepared(spark, folder).select(KEY, "Origin", "Carrier")
    return index(("Origin", "Carrier")).fit(rows).transform(rows)


@query
def index_keep(spark, folder):
    categories = ("Origin", "Dest", "Carrier")
    fitted = index(categories, "keep").fit(training(spark, folder))
    # Some origins have a name that training has not seen.
    origin = F.when(F.col(KEY) % 7 == 0, F.concat(F.lit("new "), "Origin")).otherwise(F.col("Origin"))
    rows = prepared(spark, folder).select(KEY, origin.alias("Origin"), "Dest", "Carrier")
    return fitted.transform(rows)


@query
def one_hot_origin(spark, folder):
    rows = prepared(spark, folder).select(KEY, "Origin")
    indexed = index(("Origin",)).fit(rows).transform(rows)
    vectors = one_hot(("Origin",)).fit(indexed).transform(indexed)
    ones = F.transform(vector_to_array("OriginVec"), lambda v: v.cast("int").cast("string"))
    return vectors.select(KEY, "Origin", F.array_join(ones, "").alias("indicators"))


def _assembled(spark, folder, version, layout, categories, width):
    rows = prepared(spark, folder, version)
    rows = index(categories, "keep").fit(rows).transform(rows)
    vector = vector_to_array("features")
    return assemble(layout).transform(rows).select(
        KEY, *[vector[i].alias(f"f{i}") for i in range(width)]
    )


@query
def assembled_l1(spark, folder):
    rows = prepared(spark, folder, "V1")
    rows = index(("Origin",)).fit(rows).transform(rows)
    rows = assemble("L1").transform(one_hot(("Origin",)).fit(rows).transform(rows))
    # Indicators come first and their number depends on the data; count from the end.
    vector = vector_to_array("features")
    numbers = [F.element_at(vector, i - 8).alias(f"f{i}") for i in range(8)]
    return rows.select(KEY, F.size(vector).alias("width"), *numbers)


@query
def assembled_l2(spark, folder):
    return _assembled(spark, folder, "V2", "L2", ("Origin", "Carrier"), 9)


@query
def assembled_l3(spark, folder):
    return _assembled(spark, folder, "V3", "L3", ("Origin", "Dest", "Carrier"), 10)


# --- models -------------------------------------------------------------------


def _holdout(recipe: str) -> Query:
    def run(spark, folder):
        p = delay_probability()
        sound = p.between(0.0, 1.0) & (F.col("prediction") == (p > 0.5).cast("double"))
        return experiment(spark, folder, recipe).predictions.select(
            KEY, "Label", F.coalesce(sound, F.lit(False)).alias("sound")
        )

    run.__name__ = f"holdout_{recipe}"
    return run


def _importances(recipe: str) -> Query:
    def run(spark, folder):
        found = experiment(spark, folder, recipe).importances
        total = found.agg(F.sum("importance")).scalar()
        sound = F.col("importance").between(0.0, 1.0) & (F.abs(total - 1.0) < 1e-9)
        return found.select("position", "name", sound.alias("sound"))

    run.__name__ = f"importances_{recipe}"
    return run


def _model_auc(recipe: str) -> Query:
    def run(spark, folder):
        done = experiment(spark, folder, recipe)
        agreed = F.lit(metrics.evaluator_auc(done.predictions, bins=0))
        return done.auc.select(
            (F.abs(F.col("auc") - agreed) < 1e-9).alias("agrees"),
            (F.col("auc") > 0.6).alias("informative"),
            "positives",
            "negatives",
        )

    run.__name__ = f"auc_{recipe}"
    return run


for _recipe in ("baseline", "carrier", "route", "balanced"):
    query(_holdout(_recipe))
    query(_importances(_recipe))
    query(_model_auc(_recipe))


@query
def service_scores(spark, folder):
    scored = score(service_model(spark, folder), prepared(spark, folder))
    raw = vector_to_array("rawPrediction")[1]
    # What boosting defines: the logistic function of twice the margin.
    expected = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * raw))
    return scored.select(KEY, (F.abs(delay_probability() - expected) < 1e-9).alias("logistic"))


@query
def auc_by_hour(spark, folder):
    return _rounded(metrics.auc(prepared(spark, folder), "Hour"))


@query
def auc_by_carrier_rate(spark, folder):
    rows = prepared(spark, folder)
    rates = rows.groupBy("Carrier").agg(F.round(F.avg("Label"), 6).alias("rate"))
    return _rounded(metrics.auc(rows.join(rates, "Carrier"), "rate"))


@query
def auc_many_scores(spark, folder):
    noisy = prepared(spark, folder).withColumn(
        "noisy", F.col("DepDelayMinutes") + F.col("Wind_Speed") * F.lit(2.0)
    )
    return _rounded(metrics.auc(noisy, "noisy"))


@query
def auc_toxic_by_length(spark, folder):
    return _rounded(metrics.auc(toxic_documents(spark, folder), "n_chars"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("auc", F.round("auc", 9))


@query
def compared_runs(spark, folder):
    rows = prepared(spark, folder)
    runs = {"hour": metrics.auc(rows, "Hour"), "wind": metrics.auc(rows, "Wind_Speed")}
    return _rounded(metrics.compare(runs)).withColumn("delta", F.round("delta", 9))


@query
def compared_models(spark, folder):
    """Two models' AUC beside the recorded one: what SQL can say of them."""
    runs = {r: experiment(spark, folder, r).auc for r in ("route", "balanced")}
    compared = metrics.compare(runs)
    sound = F.col("auc").between(0.5, 1.0) & (F.abs(F.col("auc") - fixed.RECORDED_AUC - F.col("delta")) < 1e-12)
    return compared.select("run", sound.alias("sound"))


@query
def model_vocabularies(spark, folder):
    return model_vocabulary(service_model(spark, folder), prepared(spark, folder))


@query
def valid_requests_carrier(spark, folder):
    good, _ = split_bad(_coerced(spark, folder))
    known = vocabulary(prepared(spark, folder)).where("kind <> 'Dest'")
    return valid_request(
        good.select(*RAW_REQUEST.names), known, fixed.INPUT_RANGES["carrier"], ("Origin", "Carrier")
    )


@query
def predictions_with_errors(spark, folder):
    requests = parse_requests(request_messages(spark, folder)).drop("payload", "req_ts")
    answers = predict(service_model(spark, folder), requests, "extreme")
    p = F.col("probability")
    expected = F.when(p > 0.7, "EKSTREMALNE").when(p > 0.5, "WYSOKIE").otherwise("NISKIE")
    told = F.col("verdict").startswith(F.concat(F.lit("Ryzyko: "), expected, F.lit(" (")))
    failed = F.col("verdict") == F.concat(F.lit("Błąd: "), F.col("error"))
    return answers.select(
        "request_id", "error",
        F.when(p.isNull(), failed).otherwise((F.col("risk") == expected) & told).alias("sound"),
    )


# --- streams ------------------------------------------------------------------


def _served(spark, folder):
    """A scoring service run over a topic of requests; its two output topics."""
    source = file_topic(_put(request_messages(spark, folder), scratch_path(spark, "requests")))
    out, letters = (file_topic(scratch_path(spark, n)) for n in ("responses", "letters"))
    serve(
        service_model(spark, folder), request_stream(spark, source), out, letters,
        scratch_path(spark, "progress"), availableNow=True,
    ).awaitTermination()
    return source, out, letters


@query
def stream_scoring(spark, folder):
    source, out, _ = _served(spark, folder)
    good, _ = split_bad(coerce_request(request_stream(spark, source, streaming=False)))
    batch = respond(service_model(spark, folder), good).withColumnsRenamed(
        {"probability": "p", "risk": "r"}
    )
    served = response_stream(spark, out, streaming=False)
    same = (F.col("p") == F.col("probability")) & (F.col("r") == F.col("risk"))
    return served.join(batch, "request_id", "full_outer").select(
        "request_id", F.coalesce(same, F.lit(False)).alias("same_as_batch")
    )


@query
def stream_dead_letters(spark, folder):
    """Dead letters, and whether the message each keeps has the same fault when read again."""
    _, _, letters = _served(spark, folder)
    letter = F.from_json("value", "payload string, reason string")
    kept = with_fields(messages(spark, letters, streaming=False), letter)
    again = coerce_request(with_fields(kept, decode(F.col("payload"), RAW_REQUEST), "reason"))
    same = F.col("error") == F.col("reason")
    return again.select("request_id", "error", F.coalesce(same, F.lit(False)).alias("same_again"))


@query
def stream_correlation(spark, folder):
    asked_path, answered_path = scratch_path(spark, "asked"), scratch_path(spark, "answered")
    _put(_as_messages(asked(spark, folder), "req_ts"), asked_path)
    _put(_as_messages(answered(spark, folder), "resp_ts"), answered_path)
    for path in (asked_path, answered_path):  # the time after which all limits have passed
        _put(
            spark.sql("SELECT '{}' AS value, timestamp '2100-01-01 00:00:00' AS timestamp"), path
        )
    requests = request_stream(spark, file_topic(asked_path))
    responses = response_stream(spark, file_topic(answered_path))
    matched = correlate_stream(requests, responses)
    wall = {c: F.col(c).cast("timestamp_ntz") for c in ("req_ts", "resp_ts")}
    outcome = _drain(matched, matched.schema, spark).filter(F.col("request_id").isNotNull())
    return outcome.withColumns(wall)


def _as_messages(df: DataFrame, time: str) -> DataFrame:
    fields = [c for c in df.columns if c != time]
    return df.select(
        F.to_json(F.struct(*fields)).alias("value"), F.col(time).cast("timestamp").alias("timestamp")
    )


# --- analyses -----------------------------------------------------------------


@query
def risk_by_time(spark, folder):
    return profile.risk_by_time(prepared(spark, folder))


@query
def risk_by_carrier(spark, folder):
    return profile.risk_by_carrier(prepared(spark, folder))


@query
def risk_by_route(spark, folder):
    return profile.risk_by_route(prepared(spark, folder))


@query
def risk_by_gust(spark, folder):
    return profile.risk_by_gust(prepared(spark, folder))


@query
def risk_by_icing(spark, folder):
    return profile.risk_by_icing(prepared(spark, folder))
