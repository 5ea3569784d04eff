from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import TABLES, canonical

SF = "/root/testdata/sf0.001"
QUICK = ["parsed_cells", "parse_issues", "domain_violations", "field_checks", "label_conflicts", "near_duplicate_totals",
         "dump_cell_kinds", "stratified_folds", "repeat_scores", "persistent_errors", "train_medians"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are absent")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
