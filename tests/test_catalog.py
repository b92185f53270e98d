import glob
import os

import duckdb
import pytest

from groundling.plans import catalog

D = "/root/testdata/sf0.001"


def norm(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    df = catalog.queries()[name](spark, D)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = db.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == names
    assert got == sorted((tuple(norm(dict(zip(cols, r))[c]) for c in names) for r in rel.fetchall()), key=repr)
