import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """The session's shared folder; the session is made with it."""
    return spark.conf.get("spark.checkpoint.dir")
