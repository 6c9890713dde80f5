"""Every analytics query against its SQL, at the smallest size."""

import math

import duckdb
import pytest

from steadfold.queries import ORACLE_SQL, QUERIES
from steadfold.sources.staging import scratch, staged, work_folder

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v


def table(rows):
    return sorted((tuple(map(norm, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    with scratch(spark):
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        got = table(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == table(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    """What no SQL can say is checked by the operators' tests; here, that the query has rows, and numbers where they are due."""
    with scratch(spark):
        rows = QUERIES[name](spark, SF).collect()
    assert rows and not any(isinstance(v, float) and math.isinf(v) for r in rows for v in r)
    for c in ("roc_auc", "clean_roc_auc", "id_roc_auc", "ood_roc_auc", "sign_consistency", "sensitivity"):
        assert all(r[c] is None or 0 <= r[c] <= 1 for r in rows if c in r)


def test_staged_tables_end_with_their_scratch(spark):
    import os

    with scratch(spark) as path:
        df = staged(spark.range(3), "few")
        assert df.count() == 3 and os.listdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and os.path.isdir(work_folder(spark).removeprefix("file:"))
