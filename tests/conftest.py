import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression."""
    def run(column):
        return spark.range(1).select(column.alias("x")).collect()[0][0]

    return run
