import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """A documents-like table with extra columns whose names clash with those of results and helpers."""

    def table(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema).repartition(3)
        clashing = {"n_words": "1", "fp": "2", "node": "3", "copy": "x", "a": "4", "position": "5", "n_tokens": "6", "host": "h"}
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in clashing.items() if k not in df.columns})

    return table
