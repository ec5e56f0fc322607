import random

import pandas as pd
from pyspark.sql import functions as F

from tidewell.llm import shared
from tidewell.llm.components import components


def test_join_hot_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 10)
    rnd = random.Random(3)
    left = spark.createDataFrame([(rnd.choice([7, 7, 7, None, rnd.randrange(50)]), i) for i in range(400)], "k int, n int")
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 50, 1) if k % 3], "k int, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, shared.join_hot(left, right, ["k"], how).select("k", "n", "v").collect())) == want
        counted = right.join(left.groupBy("k").agg(F.count("*").alias("rows")), "k", "left")
        assert sorted(map(str, shared.join_hot(left, counted, ["k"], how, sizes="rows").select("k", "n", "v").collect())) == want
    assert shared.join_hot(left.limit(0), right, ["k"]).count() == 0


def test_components_of_hubs_and_paths(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 10)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (2000, 2001)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i: 1000 for i in range(1000, 1061)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_cut_tables_can_be_forgotten(spark):
    import os

    d = shared.cut(spark.range(3))
    assert d.agg(F.sum("id")).first()[0] == 3 and os.path.isdir(d.tidewell_path)
    shared.forget(d)
    assert not os.path.exists(d.tidewell_path)


def test_portions_are_bounded_and_whole():
    batches = [pd.DataFrame({"x": range(a, a + n)}) for a, n in ((0, 2500), (2500, 0), (2500, 7))]
    got = list(shared.portions(iter(batches), 1000))
    assert [len(p) for p in got] == [1000, 1000, 500, 7] and [x for p in got for x in p["x"]] == list(range(2507))
