"""Every registered core query against its SQL on the smallest tables."""

import duckdb
import pytest

from ohmweave.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        df[k] = df[k].astype("float64") if df[k].dtype.kind in "if" else df[k].astype(str)
    return df.sort_values(list(df)).reset_index(drop=True)


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", queries.queries())
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = plain(queries.queries()[name](spark, sf_dir).toPandas()), plain(duck.execute(queries.oracle_sql()[name]).df())
    assert list(got) == list(want)
    assert len(got) == len(want)
    for k in got:
        assert ((got[k] == want[k]) | (got[k].isna() & want[k].isna())).all(), k


def test_the_contract_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout) >= 43
