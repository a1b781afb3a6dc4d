import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from decisionlab.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "decisionlab-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        # Small tables would otherwise end in one range, and the split path would not be tested.
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
