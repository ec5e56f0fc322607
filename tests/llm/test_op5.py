import numpy as np
import pytest

from tidewell.llm import op5_quality as op


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = op.fit_model(x, y)
    assert (0, 1) in m.pairs
    assert ((m.score(x) > 0.5) == y).mean() > 0.93


def test_score_is_the_sum_of_table_entries():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(500, 4))
    m = op.fit_model(x, (x[:, 0] + rnd.normal(size=500) > 0).astype(float))
    for row in x[:20]:
        z = m.base + sum(t[sum(e <= v for e in edges)] for t, edges, v in zip(m.tables, m.edges, row))
        for (a, b), t in zip(m.pairs, m.pair_tables):
            z += t[sum(e <= row[a] for e in m.pair_edges[a]), sum(e <= row[b] for e in m.pair_edges[b])]
        assert abs(m.raw(row[None])[0] - z) < 1e-9


@pytest.fixture(scope="module")
def scored(spark):
    return op.query(spark, "/root/testdata/sf0.1").toPandas(), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()


def test_held_out_accuracy(scored):
    got, labels = scored
    d = got.merge(labels, on="doc_id")
    d = d[d.held_out]
    bad, good = d.quality == 0, d.quality == 1
    caught, kept = (d.predicted[bad] == 0).mean(), (d.predicted[good] == 1).mean()
    print(caught, kept)
    assert caught > 0.93 and kept > 0.99


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "a b", 0.1), (2, "", 0.0), (2, "", 0.0), (3, "word " * 50000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels.limit(0))).count() == 0
