import pytest

from __spark_entry__ import entry, oracle_sql, queries


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["date", "temp"]


def test_registry_shape():
    q, s = queries(), oracle_sql()
    assert len(q) >= 40
    for name, fn in q.items():
        assert callable(fn), name
    for name, sql in s.items():
        assert sql.strip().upper().startswith("WITH"), name


def test_a_missing_dependency_leaves_only_its_queries_out(monkeypatch):
    """Whatever module the training-data subpackage misses, the other queries stay registered."""
    import importlib.util
    import sys

    import __spark_entry__
    from weekcast.queries import REGISTRY

    held = {n: m for n, m in sys.modules.items() if n.startswith("weekcast.llm") or n == "corpus_pipeline"}
    for name in held:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)  # importing it fails
    monkeypatch.setitem(sys.modules, "zstandard", None)
    spec = importlib.util.spec_from_file_location("entry_again", __spark_entry__.__file__)
    again = importlib.util.module_from_spec(spec)
    with pytest.warns(UserWarning, match="left out: no module named"):
        spec.loader.exec_module(again)
    assert set(again.queries()) == set(REGISTRY) and set(again.oracle_sql()) <= set(REGISTRY)
    for name in [n for n in sys.modules if n.startswith("weekcast.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    sys.modules.update(held)
