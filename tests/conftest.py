import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from strata.session import build_session

    ckpt = tempfile.mkdtemp(prefix="strata-test-ckpt-")
    spark = build_session(
        "local[4]", "strata-tests", shuffle_partitions=8,
        conf={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": f"{ckpt}/warehouse"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture()
def work(spark):
    from strata.session import shared_dir

    return shared_dir(spark, "tests", unique=True)
