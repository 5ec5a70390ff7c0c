import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from upswell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "tests", **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of expressions over a one-row frame."""

    def values(*columns):
        return tuple(spark.range(1).select(*columns).first())

    return values
