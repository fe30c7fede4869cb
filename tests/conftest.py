import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("CADENCE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cadence.session import get_session
    s = get_session("local[4]", 4, app="cadence-tests")
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cadence-test-ckpt-"))
    yield s


def rows(df, *cols):
    """Collect ``cols`` as a list of tuples, in the frame's order."""
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
