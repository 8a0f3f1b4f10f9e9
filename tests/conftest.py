import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("quire-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quire-test-ckpt-"))
    from quire.session import ship_package
    ship_package(s)
    yield s


def files_df(spark, rows, corpus="p"):
    """rows: list of (path, content) or (corpus, path, content)."""
    from pyspark.sql import functions as F
    data = [(corpus, *r) if len(r) == 2 else r for r in rows]
    df = spark.createDataFrame(data, "corpus_id string, path string, content string")
    return df.withColumn("size", F.octet_length("content").cast("long"))
