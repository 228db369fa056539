"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from graphwright.plans import bridge, projects  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(D):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(bridge.ORACLES))
def test_matches_sql(spark, duck, name):
    df = bridge.QUERIES[name](spark, D)
    result = duck.execute(bridge.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(tuple(r) for r in df.select(*names).collect()) == norm(result.fetchall())


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """One nation with 100 suppliers, so a scene with more nodes than a context shows."""
    d, con = str(tmp_path_factory.mktemp("crowded")), duckdb.connect()
    con.execute("create table region as select 0 as r_regionkey, 'R' as r_name")
    con.execute("create table nation as select i::int as n_nationkey, 'N' || i as n_name, 0 as n_regionkey from range(3) t(i)")
    con.execute("create table supplier as select i as s_suppkey, 'S' || i as s_name, 2 as s_nationkey, 0.0::double as s_acctbal from range(100) t(i)")
    for t in ("region", "nation", "supplier"):
        con.execute(f"copy {t} to '{d}/{t}.parquet'")
    return d, con


@pytest.mark.parametrize("name, shown", [("context_nodes", 60), ("context_relationships", 80)])
def test_whole_neighbourhood_of_a_large_scene(spark, crowded, name, shown):
    d, con = crowded
    result = con.execute(bridge.ORACLES[name])
    names = [c[0] for c in result.description]
    wanted = norm(result.fetchall())
    assert len(wanted) > shown
    assert norm(tuple(r) for r in bridge.QUERIES[name](spark, d).select(*names).collect()) == wanted


def test_a_context_still_shows_few(spark, crowded):
    seeds, around, g = projects._around(spark, crowded[0])
    rows = projects.N.related(seeds, around, g.nodes)
    assert [r["id"] for r in rows.collect()] == [r["id"] for r in projects.N.related(seeds, around, g.nodes, limit=None).collect()][:60]
    assert projects.N.relationships(around).collect() == projects.N.relationships(around, limit=None).collect()[:80]
