from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from compare import SF, duck  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from sigloom.session import local_session
    s = local_session(8, **{"spark.ui.showConsoleProgress": "false",
                            "spark.python.sql.dataFrameDebugging.enabled": "false"})
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture(scope="session")
def bars(spark):
    from sigloom.session import materialise
    from sigloom.sources import fixtures as fx
    return materialise(fx.daily_bars(spark, SF))
