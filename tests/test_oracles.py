"""Every query of the library against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from conftest import SF_SMALL
from offerflow.plans.registry import ORACLES, QUERIES
from tools.check_oracle import TABLES, digest

# These share their rows with a query that is compared, and take long to run.
SAME_ROWS = {"stream_ingest", "score_offers", "offer_cv_pairs", "snk_report", "snk_working_set"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SAME_ROWS))
def test_query_equals_its_sql(spark, duck, name):
    from offerflow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    cols, expected = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(expected) > 0
    assert digest(df.columns, rows) == digest(cols, expected)
