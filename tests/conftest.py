import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from conceptsearch.session import build_session, checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "conceptsearch-tests", shuffle_partitions=4)
    # tests on one machine: use a temporary folder only when the session
    # names no shared checkpoint folder
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="cs-test-ckpt-"))
    yield s
    s.stop()
