import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tempora.session import build_session

    scratch = tempfile.mkdtemp(prefix="tempora-test-")
    s = build_session("local[4]", shuffle_partitions=4, app="tempora-tests",
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tempora-case-")
