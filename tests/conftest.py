import pytest

from quillspark.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[2]", {"spark.sql.shuffle.partitions": "3", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as parquet files into a directory and returns it."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
