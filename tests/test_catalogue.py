"""Every query of the library's own operators against its SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from typedlake import catalogue

from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, tmp_path, name):
    df = catalogue.QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got = sql.sql(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    wanted = sql.sql(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})")
    assert got.types == wanted.types
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(got.fetchall(), key=key) == sorted(wanted.fetchall(), key=key)
