import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from webloom.session import build_session
    s = build_session("local[4]", 8, app_name="webloom-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="webloom-test-ckpt-")})
    yield s
    s.stop()
