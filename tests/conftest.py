import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rulelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", "local[4]", 4, **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    def make(rows):
        return spark.createDataFrame(rows, "path string, content string")

    return make
