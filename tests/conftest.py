import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")
    from pyspark.sql import SparkSession

    from lodestrata.session import prepare

    base = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.driver.extraJavaOptions", f"-Dderby.system.home={base}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
