import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from costloom.session import build_session, pin_utc  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__sql__streaming__metricsEnabled="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    pin_utc(s)
    yield s
    s.stop()
