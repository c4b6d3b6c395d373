import pytest

from granary.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session("local[4]", 4, "tests", **{
        "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{folder}/ckpt", "spark.sql.warehouse.dir": f"file://{folder}/wh",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
