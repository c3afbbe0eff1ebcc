import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    return local_session(
        "tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared"}
    )
