import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.session import SMALL_BYTES_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def distributed(spark):
    """Make every size check choose the distributed form."""
    spark.conf.set(SMALL_BYTES_KEY, "0")
    yield spark
    spark.conf.unset(SMALL_BYTES_KEY)


@pytest.fixture
def local_form(spark):
    """Make every size check choose the one-task form."""
    spark.conf.set(SMALL_BYTES_KEY, str(2**62))
    yield spark
    spark.conf.unset(SMALL_BYTES_KEY)
