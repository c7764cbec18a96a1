"""A sample of registered queries against DuckDB; check_queries.py runs them all."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check_queries import TABLES, spark_rows

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "yearly_shares_flagship", "left_join_two_keys_j1", "forward_fill_w6", "footnote_split_x6", "numeric_descriptives_p8",
    "spearman_pairs_p17", "generation_annual_b5", "reconciliation_b7_j5", "bootstrap_growth_q2", "mean_shift_q13", "html_cells_s1",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple("NULL" if r[i] is None else repr(r[i]) for i in order) for r in result.fetchall())
    assert spark_rows(contract.queries()[name](spark, SF)) == (sorted(names), want)


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150
