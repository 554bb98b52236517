import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from webloom.session import build_session
    s = build_session("local[4]", 4, app_name="webloom-llm-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="webloom-llm-ckpt-")})
    yield s
