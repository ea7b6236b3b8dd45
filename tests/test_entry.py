"""The driver's contract."""

import importlib
import sys

from tessera.plans import catalog


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.queries()) == set(catalog.oracle_sql()) | {"ann_topk_batch"}


def test_entry_without_the_training_data_operators(monkeypatch):
    monkeypatch.setattr("importlib.util.find_spec", lambda name: None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
