import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from forumloom.session import local_session, shared_folder

    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    shared_folder(session)
    yield session
    session.stop()
