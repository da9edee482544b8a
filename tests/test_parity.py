"""Every registered query against its SQL answer on the smallest given tables."""
import pytest

import parity
from clewline.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return parity.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    status, _, _ = parity.compare(spark, con, FOLDER, name)
    assert status in ("ok", "rows-only"), status
