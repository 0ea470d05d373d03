import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# names the examples below treat as known first names
NAMES = [
    "ida", "wendel", "harbisson", "marigold", "corin", "nestor", "tilda", "beatrice",
    "clementa", "odette", "jane", "sybila", "noor", "philippa",
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="personae-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


@pytest.fixture(scope="session")
def dictionary(names):
    from personae.operators.dictionary import NameDictionary

    return NameDictionary(names)


@pytest.fixture(scope="session")
def now(spark):
    from pyspark.sql import functions as F

    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a Column function on single values: apply(fn, [v1, v2]) -> results."""
    from pyspark.sql import functions as F

    def run(fn, values, schema="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, v {schema}")
        rows = df.select("i", fn(F.col("v")).alias("r")).collect()
        return [r.r for r in sorted(rows, key=lambda r: r.i)]

    return run
