import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hanmaru.session import build_session  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not SMALL.exists():
        pytest.skip("test tables are not there")
    return str(SMALL)
