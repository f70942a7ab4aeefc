"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from recall_spark.registry import ORACLES, QUERIES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    f = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(f(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLES[name]})").fetchall()
    rows = canonical(got.select(*[f"`{n}`" for n in names]).collect())
    want = canonical(want)
    assert len(rows) == len(want)
    assert rows == want
    assert rows, "nothing compared"
