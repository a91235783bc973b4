"""Every registered query runs, and matches its SQL over the whole tables."""

from __future__ import annotations

import os

import pytest

from opinara.plans import catalog
from tests.parity import DATA, compare

SF_DIR = f"{DATA}/sf{os.environ.get('OPINARA_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.CHECK_SQL))
def test_matches_sql(spark, name):
    out = compare(spark, catalog.QUERIES[name], catalog.CHECK_SQL[name], SF_DIR)
    assert out["ok"], out.get("why")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.CHECK_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_check_sql_belongs_to_queries():
    assert set(catalog.CHECK_SQL) <= set(catalog.QUERIES)
