import duckdb
import pandas as pd
import pytest

from tests.conftest import SF
from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)
