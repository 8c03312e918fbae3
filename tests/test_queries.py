"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import same

from granary import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, name):
    query = registry.queries()[name]
    if name in SQL:
        same(spark, small, query, SQL[name])
    else:
        df = query(spark, small)
        assert df.columns and df.count() > 0


def test_entry_point_runs_without_llm(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    for name in [m for m in sys.modules if m.startswith("granary.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "granary.llm", None)
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(registry.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
