import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from reckoner import build_session

    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from reckoner.sources.fixtures import Fixtures

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return Fixtures(spark, SF_DIR)


def history(spark, rows):
    """Interactions from (user, item, time) triples; the time is also the tie-break."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(u, i, t) for u, i, t in rows], "user_id long, item_id long, t long")
    return df.select(
        "user_id",
        "item_id",
        F.col("t").cast("string").alias("invoice_id"),
        F.lit(1).alias("quantity"),
        F.lit(None).cast("double").alias("unit_price"),
        F.timestamp_seconds("t").alias("ts"),
        F.col("t").alias("k1"),
        F.lit(0).cast("long").alias("k2"),
    )
