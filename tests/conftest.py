import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="ledgerlens-tests", shuffle_partitions=4,
                  extra={"spark.sql.streaming.noDataMicroBatches.enabled": "false",
                         "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
