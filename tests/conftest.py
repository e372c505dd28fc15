import pathlib
import sys

import pytest

_HERE = pathlib.Path(__file__).resolve().parent
sys.path[:0] = [str(_HERE.parent), str(_HERE)]

from core_rows import LOG_SCHEMA, REFERENCE_SCHEMA, reference_rows  # noqa: E402
from obslab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def reference(spark):
    return spark.createDataFrame(reference_rows(), REFERENCE_SCHEMA)


@pytest.fixture
def make_log(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LOG_SCHEMA)
