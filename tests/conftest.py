import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from versionlake.session import build_session
    session = build_session("tests", "local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
