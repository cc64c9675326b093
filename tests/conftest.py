import tempfile

import pytest

from pulsegrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="pulsegrid-test-")


@pytest.fixture
def small_groups(spark):
    """Makes nearly every key count as large."""
    spark.conf.set("spark.pulsegrid.maxGroupRows", "40")
    yield
    spark.conf.unset("spark.pulsegrid.maxGroupRows")
