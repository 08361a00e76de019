"""Every registered query against its SQL on the smallest test data."""

import sys

import pytest

import __spark_entry__ as contract
from oracle_check import difference, sql_engine

ORACLE = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def engine(folder):
    return sql_engine(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, engine, name):
    if name in ORACLE:
        assert difference(spark, engine, QUERIES[name], ORACLE[name], folder) is None
    else:
        assert QUERIES[name](spark, folder).count() > 0


def test_corpus_is_left_out_where_it_cannot_be_imported(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lagcast.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    left = contract.queries()
    assert "class_proportions" in left and not any(n == "pipeline" or n.startswith("op") for n in left)
    assert set(contract.oracle_sql()) <= set(left)


def test_oracle_has_no_strays():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).columns == ["Label", "count", "Proportion"]
