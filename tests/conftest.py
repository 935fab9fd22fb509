import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MESSY = [("Alice", "25", "a@b.com", 100, "yes"), ("Bob", "30", None, 200, "no"), ("alice", "25", "a@b.com", 100, "yes"), (" Charlie ", "35", "c@d.com", 999, "Yes"), ("Bob", "30", None, 200, "no"), ("Bob", "30", None, 200, "no"), ("David", "40", "d@e.com", 150, "yes"), ("EVE", "22", None, 180, "YES"), ("frank", "28", "f@g.com", 170, "No"), ("Grace", "33", "g@h.com", 160, "yes")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    where = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.host": "127.0.0.1", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{where}/checkpoints", "spark.sql.warehouse.dir": f"{where}/warehouse"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(MESSY, "name string, age string, email string, score bigint, active string")
