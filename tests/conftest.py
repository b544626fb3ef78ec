import tempfile

import pytest

from lattica.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
