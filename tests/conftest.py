import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dataprobe.session import JobConfig, build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(JobConfig(cores=4, partitions=4, master="local[4]", app_name="tests"),
                            spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def change(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples."""

    def get(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
