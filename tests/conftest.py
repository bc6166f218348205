import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from gridsight.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def tiny_limits(monkeypatch):
    """Send every size-checked operator down its path for large tables."""
    from gridsight.operators import ordered, quantiles, statistics
    monkeypatch.setattr(quantiles, "EXACT_ROWS", 50)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 200)
    monkeypatch.setattr(statistics, "EXACT_ROWS", 50)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", 0)
    monkeypatch.setattr(ordered, "BLOCK", 100)
