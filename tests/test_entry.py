import importlib.util
import sys

import pytest


def load(monkeypatch, absent):
    for name in [n for n in sys.modules if n == "__spark_entry__" or n.startswith("sievora.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if absent != "sievora.llm":
        monkeypatch.setitem(sys.modules, absent, None)
    else:

        class Absent:
            @staticmethod
            def find_spec(name, path=None, target=None):
                if name == "sievora.llm":
                    raise ModuleNotFoundError("No module named 'sievora.llm'", name=name)

        monkeypatch.delattr(sys.modules["sievora"], "llm", raising=False)
        monkeypatch.setattr(sys, "meta_path", [Absent, *sys.meta_path])
    return importlib.import_module("__spark_entry__")


@pytest.mark.skipif(importlib.util.find_spec("sievora.llm") is None, reason="the package is absent")
def test_a_failed_import_inside_the_package_is_an_error(monkeypatch):
    with pytest.raises(ImportError):
        load(monkeypatch, "duckdb")


def test_the_package_itself_may_be_absent(monkeypatch):
    entry = load(monkeypatch, "sievora.llm")
    assert {"p3_found", "p3_totals", "search_topk"} <= set(entry.queries())
    assert not [name for name in entry.queries() if name[:2] in ("p1", "p2", "p4", "p5", "p6", "p7", "p8")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
