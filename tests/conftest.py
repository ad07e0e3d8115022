import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from seqloom.session import local_session

    session = local_session("tests", cpus=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def lists():
    """Rows of a sketch as one list per sequence."""

    def collect(df, column="pos"):
        found: dict = {}
        for row in sorted(df.collect(), key=lambda r: (r["seq_id"], r[1])):
            found.setdefault(row["seq_id"], []).append(row[column])
        return found

    return collect
