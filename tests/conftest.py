import pytest

from assay.sources.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
