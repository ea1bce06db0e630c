import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from findings_lake.session import local_session
    s = local_session(4, shuffle_partitions=4, app="findings_lake_tests")
    yield s
    s.stop()


def replies_df(spark, raws):
    rows = [(f"f#{i}", "f.py", i, r, None) for i, r in enumerate(raws)]
    return spark.createDataFrame(
        rows, "request_id string, file string, fn_ord int, raw string, error string")
