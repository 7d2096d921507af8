import importlib
import sys

import __spark_entry__ as entry


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "item_id", "score", "rank"] and df.count() > 0


def test_imports_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lumenrec.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "lumenrec.llm", None)
    try:
        mod = importlib.reload(entry)
        assert "pipeline" not in mod.queries() and not [n for n in mod.queries() if n.startswith("op")]
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
