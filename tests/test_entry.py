"""The driver's three functions, with and without the subpackage llm."""

import builtins
import importlib
import sys

import pytest


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c_name", "n_name", "o_orderkey", "o_totalprice"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(monkeypatch):
    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith(("lodestone.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    for m in [m for m in sys.modules if m.startswith(("lodestone.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    e = importlib.import_module("__spark_entry__")
    assert "flagship" in e.queries() and not any(q.startswith("op") for q in e.queries())
    assert set(e.oracle_sql()) == set(e.queries())


def test_a_broken_llm_is_not_hidden(monkeypatch):
    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "lodestone.llm.queries":
            raise ModuleNotFoundError("some library", name="some_library")
        return real(name, *a, **k)

    import __spark_entry__ as e

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
