import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from scriptorium.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="scriptorium-test-ckpt-")
    s = get_spark("local[4]", app="scriptorium-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(spark):
    from scriptorium.session import checkpoint_dir
    return tempfile.mkdtemp(prefix="t-", dir=checkpoint_dir(spark))
