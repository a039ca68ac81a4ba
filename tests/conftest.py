from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import local_session

    session = local_session("4", "tagweave-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
