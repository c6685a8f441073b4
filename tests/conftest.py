import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("4", shuffle_partitions=4, memory="4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def every_partition(spark):
    """Small partitions stay apart, so a test can see how rows were spread."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "-1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)
