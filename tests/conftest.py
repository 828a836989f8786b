import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shopspark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def small():
    return SMALL


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
