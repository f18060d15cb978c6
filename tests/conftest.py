import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers

from gradeframe.session import local_session  # noqa: E402


def pytest_configure(config):
    # Column literals at module level need a session while tests are collected.
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    local_session("gradeframe-tests", cores="4", memory="4g", checkpoint_dir=folder)


@pytest.fixture(scope="session")
def spark():
    session = local_session("gradeframe-tests", cores="4", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a single row of named values."""

    def value(column, **values):
        names = list(values) or ["x"]
        types = {str: "string", int: "bigint", bytes: "binary", float: "double", type(None): "string"}
        schema = ", ".join(f"{n} {types[type(values.get(n))]}" for n in names)
        row = spark.createDataFrame([tuple(values.get(n) for n in names)], schema)
        return row.select(column.alias("v")).first().v

    return value
