import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sheetwise.session import ensure_checkpoint_dir, get_session
    s = get_session("local[4]", 4, app_name="sheetwise-tests")
    ensure_checkpoint_dir(s, allow_local=True)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="sheetwise-test-")
