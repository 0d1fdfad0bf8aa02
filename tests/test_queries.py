"""Every registered reference query against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import spark_rows, sql_rows

from lumenvec.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = spark_rows(df)
    if name in catalog.ORACLE_SQL:
        assert rows == sql_rows(catalog.ORACLE_SQL[name], sf, sorted(df.columns))
    else:
        assert rows


def test_parts_grow_with_rows(spark, sf, monkeypatch):
    """Links and faces are dealt in parts of so many rows, whatever Spark would join; m2's rows are the same."""
    from lumenvec.plans import tables

    few = tables.movie_cast(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(tables, "TASK_ROWS", 150)
    rows = tables.table(spark, sf, "lineitem").count()
    assert tables.movie_cast(spark, sf).rdd.getNumPartitions() == -(-rows // 150) > few
    assert tables.detection(spark, sf).rdd.getNumPartitions() == -(-tables.table(spark, sf, "events").count() // 150)
    df = catalog.QUERIES["m2_delete_movies"](spark, sf)
    assert spark_rows(df) == sql_rows(catalog.ORACLE_SQL["m2_delete_movies"], sf, sorted(df.columns))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 101


def test_llm_is_optional(monkeypatch):
    """Without the training-data folder and the pipeline, the other queries remain."""
    import importlib

    import __spark_entry__

    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(("lumenvec.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalog.ORACLE_SQL)
