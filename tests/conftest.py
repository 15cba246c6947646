import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes a corpus of texts; ids are given or 1, 2, ..."""
    from textloom.sources.texts import from_texts

    def make(texts, ids=None, **how):
        ids = ids or [str(k + 1) for k in range(len(texts))]
        return from_texts(spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string"), **how)

    return make
