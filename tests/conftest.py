import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [p for p in [ROOT] if p not in sys.path]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in [os.environ.get("PYTHONPATH")] if p]])
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakeloom.runtime import session

    there = tmp_path_factory.mktemp("shared")
    found = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{there}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF
