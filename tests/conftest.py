import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from eraflow.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def tiny_groups(spark):
    """Force the layouts for oversized groups."""
    spark.conf.set("spark.eraflow.maxGroupRows", "7")
    yield
    spark.conf.unset("spark.eraflow.maxGroupRows")


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.eraflow.broadcastRows", "0")
    yield
    spark.conf.unset("spark.eraflow.broadcastRows")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
