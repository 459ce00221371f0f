import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cloakroom.session import checkpoint_dir, local_session

    s = local_session("*", shuffle_partitions=8, app="cloakroom-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def texts(spark):
    def make(rows):
        return spark.createDataFrame(rows, "session string, ord long, field_pos int, text string")

    return make
