import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns
    whose names the operators use inside."""
    from llm_rows import ROWS
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in ("id", "key", "sha", "n", "h", "bucket", "shard", "slot", "rep", "top", "norm", "words", "score", "label", "file", "base"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
