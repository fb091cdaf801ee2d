"""Every query of the core against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check

_CORE = {name: q for module in entry._MODULES if ".llm." not in module.__name__ for name, q in module.QUERIES.items()}
_SQL = {name: sql for module in entry._MODULES if ".llm." not in module.__name__ for name, sql in module.SQL.items()}


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, data, duck, name):
    check(_CORE[name](spark, data), duck.sql(_SQL[name]))


def test_entry_and_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "eventloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "eventloom.llm" not in path.read_text(), path
