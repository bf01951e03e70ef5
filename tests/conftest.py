import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mirrorfold.session import build_session

    session = build_session(
        "tests", "local[8]", **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "8g",
            # the fixtures are tiny: compiling a plan takes longer than running it
            "spark.default.parallelism": "2", "spark.sql.codegen.wholeStage": "false",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
