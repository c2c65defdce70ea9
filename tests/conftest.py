import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, 8, "tests", str(shared))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch()
    left = [p for p in shared.rglob("*") if p.is_file()]
    session.stop()
    assert not left, left[:5]
