import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palisade.session import local_session  # noqa: E402

FILE_SCHEMA = "repo_id bigint, path string, content string"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "palisade-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    def make(*repositories: dict[str, str]):
        rows = [(i, p, c) for i, files in enumerate(repositories) for p, c in files.items()]
        return spark.createDataFrame(rows, FILE_SCHEMA)

    return make
