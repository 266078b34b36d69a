import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    s = local_session("tests", "4", memory="4g", partitions=4, **{"spark.checkpoint.dir": str(folder / "shared"), "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.local.dir": str(folder / "local")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
