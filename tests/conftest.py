import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from proofmill.session import build_session

    session = build_session(
        "proofmill-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def files(spark):
    """Build project, path, kind, content rows from a dict of path to text."""
    def build(content: dict[str, str]):
        rows = [
            (path.split("/")[0], path, "test" if "/evosuite-tests/" in path else "src", text)
            for path, text in content.items()
        ]
        return spark.createDataFrame(rows, "project string, path string, kind string, content string")
    return build
