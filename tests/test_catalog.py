"""Every query runs; where SQL expresses it, DuckDB gives the same rows."""

from __future__ import annotations

import duckdb
import pytest

from lumenlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]

    def cell(v):
        if isinstance(v, float):
            return ("n", round(v, 5) + 0.0)
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return ("s", str(v))
        if isinstance(v, int):
            return ("n", float(v))
        return ("s", str(v))

    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n in catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    result = oracle.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical(got, frame.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL and n not in ("nested_cross_validation", "jittered_masks", "locked_evaluation", "screen_rbf_svm", "permutation_importance", "screen_extra_trees", "screen_boosted", "screen_histogram_boosted")))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).limit(5).collect()


def test_names_and_sql_fit_together():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["auc"] <= 1 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
