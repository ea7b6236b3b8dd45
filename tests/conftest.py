import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")
os.environ["PYTHONPATH"] = f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session("4", 4, "6g")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
