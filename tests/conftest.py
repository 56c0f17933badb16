import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowsieve.session import local_session  # noqa: E402

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, name="tests")
    yield session
    session.stop()


@pytest.fixture()
def sliced(spark):
    """Tables count as large from 100 rows on, so ordered operators work in slices."""
    spark.conf.set("flowsieve.rows.per.slice", "100")
    yield spark
    spark.conf.unset("flowsieve.rows.per.slice")
