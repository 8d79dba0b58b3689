import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerolytics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="aero-test-ckpt-"),
                             "spark.sql.files.maxPartitionBytes": "256"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
