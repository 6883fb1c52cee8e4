import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from platewise.session import get_spark

    session = get_spark(master="local[*]", shuffle_partitions=8, driver_memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def venues_small(spark):
    from platewise.sources.testdata import venues

    return venues(spark, SF_SMALL).cache()
