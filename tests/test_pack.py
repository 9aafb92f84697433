"""Each query of the pack against its SQL."""

import os

import duckdb
import pytest

from quarry.plans import registry

#: Slow in the other engine; the driver compares them.
SLOW = {"match_multi_pattern"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    r = con.execute(registry.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(dict(zip(names, row))[c]) for c in sorted(names)) for row in r.fetchall())
    got = sorted(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert got == want


#: Keys whose sizes lie about each unit, and far beyond the last one that the SQL has.
LARGE_KEYS = {
    "fn_byte_units": ("orders", "o_orderkey", [0, 18, 19, 591, 592, 18918, 18919, 605395, 605396, 605397, 9_000_000, 19_373_000, 619_925_131, 1_753_413_056]),
    "fn_format_size": ("part", "p_partkey", [0, 10, 11, 50, 101, 102, 1023, 1024, 10320, 10321, 10322, 10350, 119_999, 208_063, 208_064, 350_001, 358_600]),
}


@pytest.mark.parametrize("name", LARGE_KEYS)
def test_large_keys_equal_sql(spark, tmp_path, name):
    table, key, keys = LARGE_KEYS[name]
    spark.createDataFrame([(k,) for k in keys], f"{key} long").write.parquet(f"{tmp_path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = c.execute(registry.ORACLES[name]).fetchall()
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == len(keys)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
