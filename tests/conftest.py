import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandloom.session import get_spark

    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "3", "spark.sql.codegen.wholeStage": "false", "spark.driver.memory": "6g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    s.sparkContext.setLogLevel("ERROR")
    return s
