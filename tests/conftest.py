import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reposieve.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "reposieve-tests", **{
        "spark__sql__shuffle__partitions": "4",
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__driver__memory": "6g",
    })
    s.sparkContext.setLogLevel("ERROR")
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture
def make_files(spark):
    """Files table from ``(path, content)`` pairs of one repository."""
    def make(*pairs, owner="o", name="r"):
        rows = [(owner, name, p, len(c.encode("utf-8", "ignore")), c) for p, c in pairs]
        return spark.createDataFrame(rows, "owner string, name string, path string, length bigint, content string")

    return make
