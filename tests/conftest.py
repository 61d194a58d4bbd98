import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from launchsift.session import local_session  # noqa: E402

os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")]
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "launchsift-tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Small DataFrame from rows and a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted([tuple(r) for r in picked.collect()], key=repr)


@pytest.fixture
def rows():
    return rows_of
