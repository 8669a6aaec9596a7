"""Every registered query runs on the smallest tables and agrees with its SQL twin."""

import pytest

import __spark_entry__ as contract
from conftest import SMALL
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    ok, note = compare(name, contract.queries()[name](spark, SMALL), con)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).count() == 1500


def test_feature_outputs_are_unique():
    from sitegauge.operators import features
    from sitegauge.plans.features import INPUTS, TWINS

    names = [n for f in features.FAMILIES for n in TWINS[f]]
    assert len(names) == len(set(names))
    assert not set(names) & set(INPUTS)
