import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadline.plans.staging import remove_staged  # noqa: E402
from loadline.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(4)
    yield session
    remove_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(params=["1000000", "16"], ids=["one-block", "many-blocks"])
def blocks(request, spark):
    """Run a test with everything in one block and with many stitched blocks."""
    spark.conf.set("spark.loadline.blockRows", request.param)
    yield int(request.param)
    spark.conf.unset("spark.loadline.blockRows")
