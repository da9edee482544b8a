import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clewline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
