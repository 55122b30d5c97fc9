import importlib.util

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") or k == "open_reviews"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    ours, theirs = spark_rows(entry.queries()[name](spark, sf)), duck_rows(duck(sf), SQL[name])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]


def test_every_query_of_the_library_has_sql():
    own = {k for m in entry.MODULES for k in m.registry.queries}
    assert own == {k for m in entry.MODULES for k in m.registry.sql}


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 7


def test_the_training_data_operators_are_there_only_with_their_folder():
    has = importlib.util.find_spec("factline.llm") is not None
    assert any(k.startswith("op1_") for k in entry.queries()) == has
