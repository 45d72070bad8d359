"""Every registered query against its SQL on the smallest tables."""

import pytest

from check import compare, connect
from ringfold.plans.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"
CHECKED = [name for name, (_, sql) in REGISTRY.items() if sql]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, FOLDER, name)
    assert ok, note


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["measurement_id", "pos", "n_pixels"]
