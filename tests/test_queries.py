"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import compare
import pytest

from framelake.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare.differences(con, df, ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 27
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
