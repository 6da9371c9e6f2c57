import importlib.util
import sys
from pathlib import Path


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "logweft.llm", None)
    monkeypatch.setitem(sys.modules, "logweft.llm.queries", None)
    spec = importlib.util.spec_from_file_location("entry_alone", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert alone.queries() and not any(n.startswith("op") or n == "pipeline" for n in alone.queries())
