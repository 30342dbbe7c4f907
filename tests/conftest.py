import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ecospark.session import local_session

    s = local_session(4, shuffle_partitions=8, app="ecospark-tests")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
