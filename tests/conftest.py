import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def shared_folder(request, tmp_path_factory, monkeypatch):
    """A shared folder for each test, which goes with all that the test has written there."""
    if "spark" not in request.fixturenames:
        yield
        return
    path = tmp_path_factory.mktemp("shared")
    monkeypatch.setattr("cellspark.plans.lineage.shared_folder", lambda spark: str(path))
    yield
    shutil.rmtree(path, ignore_errors=True)
