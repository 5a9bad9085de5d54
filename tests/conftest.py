import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from scenegrade import configure

    builder = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
    )
    session = builder.getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.stop()
        session = builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tests-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)
