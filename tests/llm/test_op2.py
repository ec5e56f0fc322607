import random

import numpy as np
import pytest

from tidewell.llm import op2_toxicity as op


def brute_segments(s):
    """Maximal segments by their recursive definition."""
    if not len(s) or max(s) <= 0:
        return []
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            v = sum(s[a:b])
            if best is None or v > best[2] + 1e-9 or (abs(v - best[2]) <= 1e-9 and b - a < best[1] - best[0]):
                best = (a, b, v)
    a, b, v = best
    return brute_segments(s[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_segments_equal_the_definition():
    rnd = random.Random(4)
    for _ in range(200):
        s = [rnd.uniform(-2, 2) for _ in range(rnd.randrange(0, 14))]
        got, want = op.segments(np.array(s)), brute_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]


def test_lambda_solves_its_equation():
    v, p = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    assert abs(p @ np.exp(op.solve_lambda(v, p) * v) - 1) < 1e-6


@pytest.fixture(scope="module")
def scored(spark):
    return op.query(spark, "/root/testdata/sf0.1").toPandas(), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()


def test_held_out_accuracy(scored):
    got, labels = scored
    d = got.merge(labels, on="doc_id")
    d = d[d.held_out]
    t, p = d.toxic == 1, d.predicted == 1
    recall, precision = (t & p).sum() / t.sum(), (t & p).sum() / max(1, p.sum())
    print(recall, precision, len(d))
    assert recall > 0.85 and precision > 0.85


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "word " * 50000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_segments_of_long_texts_take_time_in_proportion():
    """Falling sums hold ever more segments, which a search from the last one back would all pass."""
    import time

    rng = np.random.default_rng(5)
    begun = time.monotonic()
    for s in (np.tile([1.0, -1.5], 500_000), np.where(rng.random(1_000_000) < 0.3, rng.uniform(0, 2, 1_000_000), -0.4), np.tile([0.5, -0.5, 1.0], 300_000)):
        got = op.segments(s)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:])) and all(x > 0 for *_, x in got)
    assert time.monotonic() - begun < 60


def test_sample_is_bounded_where_ids_repeat(spark):
    from tidewell.llm.labelled import training_sample

    ids = spark.range(3_000)
    docs = ids.selectExpr("id as doc_id", "concat('text ', id) as text")
    docs = docs.unionByName(spark.range(5_000).selectExpr("0L as doc_id", "concat('again ', id) as text")).union(docs)
    labels = ids.selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    for most in (100, 10_000):
        got = training_sample(docs, labels, "toxic", most).collect()
        assert 0 < len(got) <= most
        assert len({r.text for r in got}) == len(got)
    rows = training_sample(docs.repartition(7), labels, "toxic", 10_000).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, got))


def test_units_of_many_documents_are_held_once():
    import tracemalloc

    import pandas as pd

    words = [f"w{k:07d}" for k in range(400)]
    batch = pd.DataFrame({"text": [" ".join(words)] * 300, "label": [1, 0, 0] * 100})
    tracemalloc.start()
    got = pd.concat(list(op.document_counts(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000
    assert set(got["unit"]) == {u for w in words for u in op.units_of(w)} and len(got) == got["unit"].nunique()
    assert set(got["toxic"]) == {100} and set(got["clean"]) == {200}
