import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from vigilog.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(8, "tests", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """A function from texts to ``line_id, line``, in the given number of partitions."""

    def build(texts, partitions=2):
        rows = list(enumerate(texts))
        return spark.createDataFrame(rows, "line_id bigint, line string").repartition(partitions)

    return build
