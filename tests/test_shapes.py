"""Every shape against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexigrove.plans import flagship, shapes

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canon(rows):
    show = lambda v: "NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


QUERIES, SQL = shapes.QUERIES | flagship.QUERIES, shapes.SQL | flagship.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shape(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(map(tuple, df.collect())) == canon(want.select(*[f'"{c}"' for c in df.columns]).fetchall())


def test_reading_stats_of_ties(spark, tmp_path):
    """Shares that lie halfway between two texts, and null keys."""
    sizes = {1: (1, 31), 2: (3, 29), 3: (212, 428), 4: (107, 3893), 5: (1,), 6: (201, 19799), None: (1, 7)}
    rows = [(key, "AN"[k] if key != 2 or k else None) for key, parts in sizes.items() for k, n in enumerate(parts) for _ in range(n)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = shapes.reading_stats(spark, str(tmp_path))
    want = con.sql(SQL["reading_stats"]).select(*got.columns).fetchall()
    assert len(want) == 13 and canon(map(tuple, got.collect())) == canon(want)
