"""Every registered query of the library against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lectern.plans.all_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, tmp_path):
    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = f"read_parquet('{tmp_path}/out/*.parquet')"
    if name not in ORACLE_SQL:
        assert duck.execute(f"SELECT count(*) FROM {got}").fetchone()[0] > 0  # their rows are compared in test_operators.py
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE_SQL[name]}")
    kinds = dict(r[:2] for r in duck.execute("DESCRIBE want").fetchall())
    assert kinds == dict(r[:2] for r in duck.execute(f"DESCRIBE SELECT * FROM {got}").fetchall())
    cols = ", ".join(f'"{c}"' for c in kinds)
    for a, b in (("want", got), (got, "want")):
        assert duck.execute(f"SELECT * FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}) LIMIT 3").fetchall() == []
