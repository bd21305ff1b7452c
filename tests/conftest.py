import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT_DDL = "source_id BIGINT, event_id BIGINT, timestamp_s DOUBLE, label STRING, confidence DOUBLE, text STRING"


@pytest.fixture
def make_events(spark):
    def build(rows, source=1):
        """rows of (t, label[, text[, confidence]])"""
        full = [
            (source, i, float(r[0]), r[1], float(r[3]) if len(r) > 3 else 0.5, r[2] if len(r) > 2 else None)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(full, EVENT_DDL)

    return build
