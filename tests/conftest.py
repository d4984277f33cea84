import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rhythmlake.session import build_session

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = build_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": shared})
    yield session
    session.stop()
