import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from tidegate.plans import Tables, load  # noqa: E402
from tidegate.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def planned(spark):
    """The registered query of a name over one folder, planned once however many tests look at it."""
    plans, made = load().plans, {}

    def plan(name, folder):
        if (name, folder) not in made:
            made[name, folder] = plans[name](Tables(spark, folder))
        return made[name, folder]

    return plan


@pytest.fixture()
def rows(spark):
    """DataFrame from a schema text and tuples."""

    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return make
