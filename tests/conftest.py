from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import local_session

    return local_session(name="tests")


@pytest.fixture(scope="session")
def seed(spark):
    import seed_data

    return seed_data.tables(spark)
