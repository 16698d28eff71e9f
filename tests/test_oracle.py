"""Every registered query against its DuckDB oracle on sf0.001 (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import row_hash

QUERIES = E.queries()
ORACLE = E.oracle_sql()


NO_SQL = {"op1_quality", "op4_toxicity", "op6_language", "op8_token_ids", "op9_simhash", "op10_secrets", "pipeline"}


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) - set(ORACLE) <= NO_SQL


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "items", "pct"]
    assert df.count() == 7


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = [r.asDict() for r in sdf.collect()]
    rel = duck.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    assert sorted(dcols) == cols
    assert sorted(row_hash(cols, r) for r in srows) == sorted(row_hash(cols, r) for r in drows)
