import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textlab.session import get_spark
    s = get_spark("textlab-tests", cpus="4", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_root(tmp_path_factory):
    return str(tmp_path_factory.mktemp("textlab"))
