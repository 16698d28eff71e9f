import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kindsort.session import local_session, ship_package

    s = local_session("*", shuffle_partitions=8, app="kindsort-tests", checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for t in tables.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def inventory(spark, rows, cols=("DESCRIPTION", "VENDOR_NAME", "SUBCATEGORY")):
    schema = ", ".join(f"`{c}` string" for c in cols)
    return spark.createDataFrame(rows, schema)
