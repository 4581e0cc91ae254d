"""The entry points without the optional part."""

import importlib

import pytest

import __spark_entry__
from memspark.plans import registered


def missing(monkeypatch, what):
    real = importlib.import_module

    def load(name, *more):
        if name in __spark_entry__.LLM_MODULES:
            raise ModuleNotFoundError(f"No module named {what!r}", name=what)
        return real(name, *more)

    monkeypatch.setattr(importlib, "import_module", load)


@pytest.mark.parametrize("what", ["memspark.llm", "public_tokenizers", "sentencepiece"])
def test_without_the_optional_part(monkeypatch, what):
    missing(monkeypatch, what)
    assert set(__spark_entry__.queries()) == set(registered.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registered.ORACLES)


def test_a_fault_of_our_own_shows(monkeypatch):
    missing(monkeypatch, "memspark.operators.nothing")
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
