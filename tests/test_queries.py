"""Each registered query of the table operators against its SQL."""

import pytest

from tests.oracle import connect, same
from typeloom.plans.catalog import FLAGSHIP, QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, sf, duck):
    same(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_package(monkeypatch):
    """A missing subpackage, or a library that it needs, takes only its own queries away."""
    import importlib

    import __spark_entry__

    real = importlib.import_module

    def missing(name, *args):
        if name.startswith("typeloom.llm"):
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(SQL)
