import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from urlguard.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def psl(spark):
    from urlguard.plans.inputs import SUFFIXES

    rules = [*SUFFIXES, "*.ck", "!www.ck", "jp", "co.jp", "net"]
    return spark.createDataFrame([(r,) for r in rules], "suffix string")
