import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lexigrain.session import build_session  # noqa: E402

FIXTURES = os.path.join(ROOT, "tests", "fixtures")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on one string."""
    from pyspark.sql import functions as F

    def run(value, fn):
        kind = "binary" if isinstance(value, (bytes, bytearray)) else "string"
        return spark.createDataFrame([(value,)], f"v {kind}").select(
            fn(F.col("v")).alias("r")).head()[0]

    return run


@pytest.fixture(scope="session")
def fixtures():
    return FIXTURES
