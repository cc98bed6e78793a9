import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import local_session

    session = local_session("8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
