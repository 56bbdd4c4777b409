import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vellum.session import get_spark

    session = get_spark("vellum-tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = os.environ.get("VELLUM_DATA", "/root/testdata/sf0.001")
