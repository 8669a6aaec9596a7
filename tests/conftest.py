import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitegauge.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=8, memory="6g")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _fresh_cache(spark):
    yield
    spark.catalog.clearCache()
