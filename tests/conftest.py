import os
from pathlib import Path

import pytest

os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parents[1])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sourcelode.session import build_session

    session = build_session(
        "local[4]", "tests", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()
