import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from tessera.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(8, partitions=4, memory="8g")
    made.sparkContext.setLogLevel("ERROR")
    return made
