import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_catalog import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["residual", "filter_unchanged", "row_scores", "network_scores", "group_network_scores", "resolve_aliases", "promoter_window_upstream", "noncoding_upstream", "motif_similarity", "fill_time_series", "quantile_normalize", "cooccurrence_cloud", "read_matrix", "write_members"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 200


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "nrows", "ncols", "resid"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    assert rows and not compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])


def test_motif_queries_without_a_cut():
    assert {"motif_pvalue_matrix", "background_model", "scan_pssm", "scan_sequence_pvalue"} <= set(entry.queries()) & set(entry.oracle_sql())
