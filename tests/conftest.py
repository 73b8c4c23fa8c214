import pytest

from skirmish.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("local[4]", 4, **{"spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
