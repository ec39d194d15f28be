import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import local_session

    return local_session(4, "panelspark-tests")


@pytest.fixture(scope="session")
def small(spark):
    from panelspark.views import Tables

    return Tables(spark, SMALL)
