import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from streamlens.session import local_session

    s = local_session(4, 4, "tests")
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # compiling takes longer than running on so few rows
    yield s
    s.stop()
