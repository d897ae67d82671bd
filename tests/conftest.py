import pytest

from meritlake.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of a column expression over one text column ``x``."""
    def run(build, inputs, kind="string"):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}").coalesce(1)
        return [row.v for row in frame.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]

    return run
