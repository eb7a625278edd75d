import pytest

from gazette.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
