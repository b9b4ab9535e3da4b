import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codeeval.session import drop_scratch, get_spark
    s = get_spark("local[4]", 8, app="codeeval-tests",
                  extra={"spark.driver.memory": "8g"})
    yield s
    drop_scratch(s)
    s.stop()


def messages_df(spark, rows):
    """rows: (conv_id, turn, role, text)"""
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
