import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from objectlens.session import session

    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    made = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    made.sparkContext.setLogLevel("ERROR")
    return made
