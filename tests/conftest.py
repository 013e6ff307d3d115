import pytest

from catalog_engine.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture
def rows(spark):
    """Builds a small table from rows and a schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)
