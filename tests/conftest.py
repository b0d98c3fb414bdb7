"""One local session for all tests."""

import pytest

from glossmill.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
