import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wavelake.session import session

    root = tmp_path_factory.mktemp("spark")
    s = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{root}/shared", "spark.sql.warehouse.dir": f"{root}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
