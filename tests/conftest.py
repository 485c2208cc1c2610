import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import builder

    s = (
        builder("tests", "local[4]", 4)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from millrace.session import release

    release(s)
    s.stop()
