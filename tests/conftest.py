import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Spark's Python workers

import pytest  # noqa: E402

from recordloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.chdir(tmp_path_factory.mktemp("spark"))
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
