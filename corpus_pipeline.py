"""The corpus pipeline: stages over documents, each on all that the one before it kept.

Documents go that the quality classifier or the quality rules reject, and all but one
of each group of near copies (five-word shingles, similarity 0.8). What is left is
packed into sequences of 2048 tokens. Every stage but the last returns the columns of
its input. Tasks of the first two, whose work is on texts alone, hold ``BATCH_ROWS`` of them.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.components import stored
from lagcast.llm.compression_bands import BATCH_ROWS, compression_bands, fit_bands
from lagcast.llm.near_duplicates import near_duplicates
from lagcast.llm.packing import pack_documents
from lagcast.llm.quality_classifier import fit_quality, score_quality
from lagcast.llm.tokenizing import read_tokenizer
from lagcast.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under a struct, so none of their names meets another, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))


def _decided(docs: DataFrame, judge, verdict: str) -> DataFrame:
    """The rows of ``docs`` whose verdict holds, with the columns they had."""
    return stored(judge(_packed(docs)).where(verdict).select("row.*"), "decided", BATCH_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier bad by the compression classifier."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, label="quality")
    return _decided(docs, lambda df: score_quality(df, model, threshold=0.3), "predicted = 1")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the text rules or the compression bands, fitted to these documents, reject."""
    bands, of_chunks = fit_bands(docs)
    return _decided(docs, lambda df: compression_bands(df, bands=bands, chunk_bands=of_chunks), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows with equal ids are judged each by its own text. Of rows with the same id and text, one stays.
    """
    judged = near_duplicates(docs, width=5, percent=80, digest="digest")
    dropped = judged.where(~F.col("kept")).select("doc_id", "digest").distinct()
    packed = _packed(docs).withColumns({"doc_id": F.col("row.doc_id"), "digest": F.xxhash64("text")})
    left = packed.join(dropped, ["doc_id", "digest"], "left_anti")
    return left.dropDuplicates(["doc_id", "digest", "text"]).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return pack_documents(docs, read_tokenizer(TOKENIZER), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

# The classifier is trained and compresses; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
