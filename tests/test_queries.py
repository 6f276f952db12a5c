"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from check_oracles import compare, connect

from curatrix.plans import catalogue

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    assert compare(spark, connect(ROOT), catalogue.queries()[name], catalogue.oracle_sql()[name], ROOT) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, ROOT).count() > 0


def test_entry_without_training_queries(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
