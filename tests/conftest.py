"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    import quillstream
    from pyspark import cloudpickle

    from quillstream.session import local_session

    cloudpickle.register_pickle_by_value(quillstream)
    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
