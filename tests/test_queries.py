"""Every query against its SQL."""

import os

import duckdb
import pytest

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    theirs = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert canonical(tuple(r) for r in frame.select(*cols).collect()) == canonical([tuple(r[i] for i in order) for r in theirs.fetchall()])
