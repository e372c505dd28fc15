import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from llm_rows import CLASHES, ODD, SCHEMA, plain_rows  # noqa: E402
from obslab.llm.common import ship  # noqa: E402


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_rows():
    return plain_rows(20) + ODD


@pytest.fixture(scope="session")
def odd(shipped, odd_rows):
    return shipped.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(shipped):
    return shipped.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd table with extra columns, numbers and texts, named as operators name theirs."""
    return odd.selectExpr("*", *(f"'extra' as `{c}`" for c in CLASHES))


@pytest.fixture(scope="session")
def make(shipped):
    return lambda *rows, schema=SCHEMA: shipped.createDataFrame(list(rows), schema)
