import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
sys.path.insert(0, str(Path(__file__).parent))

import parity  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return parity.session()
