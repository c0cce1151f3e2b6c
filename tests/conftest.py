import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)

from farescope.session import build_session, use_local_work_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
    use_local_work_dir(session)
    # Python workers import the library from here, wherever the tests were started.
    session.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    yield session
    session.stop()
