import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LONG = " ".join(f"word{k % 7919} of{k % 13}" for k in range(20_000))

# Columns that operators add, as extra columns of their input.
CLASHES = {
    name: "clash"
    for name in (
        "score predicted kept n_words ratio ids start length sequence_id offset lang_pred node bands rank rule verdict host path "
        "n_shingles component_id base chunk __key __label tokens row decoded base_failed ambiguous __id __digest __group __n digest holds of"
    ).split()
}


@pytest.fixture(scope="session", autouse=True)
def on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and columns, null, empty and very long texts, ties, repeated rows, clashing columns."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the house " * 4
    rows = [
        (1, prose, "en", "a"),
        (2, prose, "en", None),
        (2, prose, "en", None),
        (3, None, None, None),
        (4, "", "de", "b"),
        (5, " \t\n", None, "b"),
        (6, LONG, "en", "c"),
        (7, LONG + " tail", "en", "c"),
        (None, prose, "en", "a"),
        (None, None, None, None),
        (8, "Straße größer über Käse, ça va? 你好 世界 \U0001f600  x", "de", "a"),
        (9, "*** $$$ ### !!!", None, "a"),
        (10, "one", "fr", "a"),
        (11, "One", "fr", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
