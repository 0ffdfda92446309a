import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hirelens.session import get_spark
    extra = {}
    # tests only: a private checkpoint folder when the session has none
    from pyspark.sql import SparkSession
    if SparkSession.getActiveSession() is None and not os.environ.get("SPARK_CHECKPOINT_DIR"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="hirelens-test-ckpt-")
    s = get_spark("local[*]", app="hirelens-tests", shuffle_partitions=8, extra=extra)
    yield s
