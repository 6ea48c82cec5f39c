import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fernwork.plans.scale import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("fernwork-tests", 8, 8)
    yield s
    s.stop()
