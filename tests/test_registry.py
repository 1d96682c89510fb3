import pytest

import __spark_entry__ as entry_point
from compare import agree
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    agree(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLE_SQL.keys()


def test_entry(spark, sf_dir):
    assert entry_point.entry(spark).columns == ["timestamp", "event_type", "usr", "value"]
    assert set(registry.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_plans(spark, sf_dir, capsys):
    registry.QUERIES["page_both"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "EqualTo(event_type,click)" in plan
    registry.QUERIES["project_fields"](spark, sf_dir).explain("formatted")
    assert "props" not in capsys.readouterr().out
