"""Score requests as they come: spark-submit lagcast/jobs/serve.py --servers ... --model ..."""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lagcast import fixed
from lagcast.operators.features import model_vocabulary
from lagcast.sources.models import load_model
from lagcast.sources.topics import Topic, kafka_sink, kafka_source, request_stream
from lagcast.sources.vocabularies import write_vocab
from lagcast.streaming.serving import serve


def run(
    spark: SparkSession, model: str, vocabulary: str, asked: Topic, answers: Topic, letters: Topic,
    checkpoint: str, **trigger,
) -> StreamingQuery:
    """Load the model, write its vocabularies for the forms, and start to answer."""
    fitted = load_model(model)
    requests = request_stream(spark, asked)
    write_vocab(model_vocabulary(fitted, requests), vocabulary)
    return serve(fitted, requests, answers, letters, checkpoint, **trigger)


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--servers", required=True, help="broker addresses")
    parser.add_argument("--model", required=True, help="folder of the fitted pipeline")
    parser.add_argument("--vocabulary", required=True, help="where the vocabularies go")
    parser.add_argument("--checkpoint", required=True, help="shared folder for the progress")
    parser.add_argument("--dead-letters", default="predict_dead_letters", help="topic of bad requests")
    given = parser.parse_args()
    run(
        SparkSession.builder.appName("lagcast-serve").getOrCreate(),
        given.model,
        given.vocabulary,
        kafka_source(given.servers, fixed.REQUEST_TOPIC),
        kafka_sink(given.servers, fixed.RESPONSE_TOPIC),
        kafka_sink(given.servers, given.dead_letters),
        given.checkpoint,
    ).awaitTermination()
