import pytest
from lodeframe.llm.common import discard, met, shared_dir, stored
from lodeframe.llm.components import components


def test_stored_tables_go(spark):
    df = stored(spark.range(10))
    path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    import os

    assert df.count() == 10 and os.path.isdir(path)
    discard(df)
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: none, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=none, sparkContext=context))


def test_met_joins_hot_keys(spark):
    rows = spark.range(1000).selectExpr("case when id < 900 then 0 else id % 7 end as k", "id")
    facts = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (50, "d")], "k long, f string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(facts, "k", how).select("k", "id", "f").collect()))
        assert sorted(map(str, met(rows, facts, "k", 16, how).select("k", "id", "f").collect())) == want


def test_components_of_stars_chains_and_rings(spark):
    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), 4).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 131)}, **{i: 200 for i in (200, 201, 202)}, 300: 300, 301: 300}
