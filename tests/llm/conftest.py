import os

import pytest

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of rows under a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)

@pytest.fixture
def folder(spark, tmp_path):
    """An input folder made of given tables."""
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write
