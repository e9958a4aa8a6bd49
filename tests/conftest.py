import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meritpool.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from meritpool.sources.starschema import StarSchema

    return StarSchema(spark, SMALL)


def rows(df, *order):
    """Rows as tuples, sorted to compare."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
