import pytest

from quillmesh.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("quillmesh-tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield session
    session.stop()
