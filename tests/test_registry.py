import math

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
LINKAGE = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", LINKAGE)
def test_query_against_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([tidy(v) for v in r]) for r in df.select(*cols).collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(str([tidy(v) for v in r]) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
