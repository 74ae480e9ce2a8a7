"""Every registered query against its DuckDB oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from trainlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY: set[str] = set()
DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["test_idx", "method", "rank", "train_idx", "score", "train_source"]


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    oracle = E.oracle_sql().get(name)
    # an empty result would prove nothing
    assert rows or name in MAY_BE_EMPTY
    if oracle is None:
        return
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracle}").fetchall()}
    for f in df.schema.fields:
        assert DUCK_TO_SPARK.get(duck_types[f.name], duck_types[f.name]) == f.dataType.simpleString(), f.name
    rel = con.execute(oracle)
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    orows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert rows == orows
