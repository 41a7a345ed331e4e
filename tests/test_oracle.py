"""Every registered query against its DuckDB SQL on the driver tables (sf0.001).

Same comparison as the driver: columns sorted by name, row count, and all
values compared as a multiset. (``scripts/check_oracle.py`` runs the same at
sf0.01.)
"""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import canon, duck
from sellerlens.catalog import QUERIES
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).fetchdf()
    cols_g, rows_g = canon(got)
    cols_w, rows_w = canon(want)
    assert cols_g == cols_w
    assert len(rows_g) == len(rows_w)
    assert rows_g == rows_w
