import __spark_entry__ as entry
from conftest import SF


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(spark, monkeypatch):
    found = entry.importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name in ("lexgrain.llm", "corpus_pipeline") else found(name, *a))
    names = entry.queries()
    assert "must_and" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
    assert names["corpus_stats"](spark, SF).count() == 1
