import json

import pytest

import __spark_entry__
from geoweave import plans
from geoweave.api import KINDS, Stack


def test_stack(spark):
    roads = spark.createDataFrame([(1, "residential", "A", None, None, None, [{"lon": 0.0, "lat": 0.0}, {"lon": 0.01, "lat": 0.0}])], "fid long, road_class string, name string, ref_tag string, oneway string, speed_limit_kmh double, coords array<struct<lon:double,lat:double>>")
    shops = spark.createDataFrame([(7, 0.0, 0.001, "Café")], "fid long, lat double, lon double, name string")
    s = Stack(spark, {"roads": roads, "businesses": shops})
    req = spark.createDataFrame([(1, 0.0001, 0.005, "road"), (2, 0.0, 0.001, "business"), (3, 0.0, 0.0, "nonsense"), (4, None, 0.0, "road"), (5, 0.0, 0.0, "park"), (6, 0.0001, 0.005, "locate"), (7, 0.0, 0.0, None)], "request_id long, lat double, lon double, query string")
    got = {r.request_id: r for r in s.serve(req).collect()}
    assert len(got) == 7 and json.loads(got[1].response)[0]["fid"] == 1 and got[2].candidate_count == 1 and got[3].error and got[4].error and got[7].error
    assert got[5].response == "[]" and got[5].error is None and json.loads(got[6].response)[0]["way_kind"] == "road"
    assert s.search("cafe").head().fid == 7 and s.geocode("x").count() == 0
    with pytest.raises(ValueError):
        s.answer(req, "x")
    assert set(KINDS) >= {"road", "all"}
    assert Stack.from_folder(spark, "/nowhere").layers == {}


def test_entry_and_registration(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "fid", "distance_m"] and df.count() > 0
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(plans.QUERIES) >= 60 and set(plans.ORACLE) <= set(plans.QUERIES)


@pytest.mark.parametrize("name", ["j1_nearest_poi", "j10_radius_join", "m1_speed_bands", "l2_coalesce", "r7_edge_dedupe", "t8_search_national"])
def test_results_do_not_depend_on_partitions(spark, name):
    run = lambda n: (spark.conf.set("spark.sql.shuffle.partitions", n), sorted(map(str, plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))[1]
    try:
        assert run("3") == run("11")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = plans.QUERIES[name](spark, sf)
    r = c.execute(plans.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    show = lambda x: repr(round(x, 5) + 0.0) if isinstance(x, float) else str(list(x)) if isinstance(x, (list, tuple)) else repr(x)
    want = sorted(tuple(show(row[names.index(k)]) for k in sorted(names)) for row in r.fetchall())
    assert sorted(tuple(show(x) for x in row) for row in df.select(*sorted(df.columns)).collect()) == want
