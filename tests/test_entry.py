import importlib
import sys

import __spark_entry__ as entry_module


def test_contract(spark):
    names = set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= names
    assert entry_module.entry(spark).schema.names == ["a", "b"]


def test_imports_without_the_optional_parts(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("lattica.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("lattica.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    lattica = importlib.import_module("lattica")
    monkeypatch.delattr(lattica, "llm", raising=False)
    module = importlib.reload(entry_module)
    names = set(module.queries())
    assert "tc_customer_tree" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
