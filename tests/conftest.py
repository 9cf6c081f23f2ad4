import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from varieta.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="varieta-tests", shuffle_partitions=8)
    checkpoint_dir(s, tempfile.mkdtemp(prefix="varieta-test-ckpt-"))
    yield s
    s.stop()
