"""Scene queries against their SQL on the smallest tables."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from roomlake.operators.quantiles import sorted_quantiles
from roomlake.registry import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_oracles())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = all_queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in names)) for r in df.collect())
    rel = con.sql(all_oracles()[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_placements_on_the_threshold(spark, tmp_path):
    """Two scenes of shifted copies, where the base of some tracks lies exactly as far from the floor as may be closed."""
    c = duckdb.connect()
    c.sql("""create table orders as select * from (select * replace (o_orderkey + k * 150000 as o_orderkey, o_custkey + k * 15000 as o_custkey)
        from '/root/testdata/sf0.1/orders.parquet', (values (5), (20)) t(k)) where o_custkey // 400 in (208, 769) order by o_orderkey""")
    c.sql(f"copy orders to '{tmp_path}/orders.parquet'")
    got = sorted(tuple(r) for r in all_queries()["placed_duplicates"](spark, str(tmp_path)).collect())
    assert len(got) > 100 and got == sorted(c.sql(all_oracles()["placed_duplicates"]).fetchall())


def test_sorted_quantiles_equal_sql(spark):
    rng, shares = random.Random(3), (0.02, 0.5, 0.98)
    lists = [sorted(rng.randint(0, 2000) / 1000 for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists + [[]])), "k int, v array<double>")
    got = {r.k: r.q for r in df.select("k", sorted_quantiles(F.col("v"), shares).alias("q")).collect()}
    c = duckdb.connect()
    for k, v in enumerate(lists):
        assert [tuple(got[k])] == c.execute("select " + ", ".join(f"quantile_cont(x, {q})" for q in shares) + " from (select unnest(?::double[]) x)", [v]).fetchall()
    assert got[len(lists)] is None


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


def test_filled_colors_of_every_wall(spark, con):
    test_query_equals_sql(spark, con, "color_field_filled")
    seen = {(r.scene, r.wall) for r in all_queries()["color_field_observed"](spark, SF).collect()}
    filled = {(r.scene, r.wall) for r in all_queries()["color_field_filled"](spark, SF).collect()}
    assert filled == seen and len({wall for _, wall in filled}) > 1
