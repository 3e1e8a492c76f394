import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lendgauge.session import local_session

    session = local_session(8, 4, "lendgauge-tests")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def app(spark, folder):
    from lendgauge.plans.loanbook import applications

    return applications(spark, folder).cache()
