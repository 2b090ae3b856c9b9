import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfscan.session import checkpoint_dir, get_session
    s = get_session("local[4]", app="shelfscan-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "6g"})
    checkpoint_dir(s)  # tests: no cluster setting, so a scratch folder is registered
    yield s
    s.stop()


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="shelfscan-test-")
