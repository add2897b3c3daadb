import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402,F401  (makes Python workers independent of the path)
from auctionflow.session import build_session, drop_stored  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    drop_stored(s)
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
