import numpy as np

from tidewell.llm import op10_neighbours as op


def brute(rows, every=50, top=5):
    good = [(i, np.array(e, float)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    ids = np.array([i for i, _ in good])
    x = np.array([e for _, e in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != k][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 60)
    monkeypatch.setattr(op, "QUERY_BLOCK", 10)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in op.search(vectors).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, w in want.items():
        g = sorted(got.get(q, []))
        assert [r for r, _, _ in g] == list(range(1, len(g) + 1)) and len(g) == 5
        of = {v: s for _, v, s in g}
        hit += sum(v in of for v, _ in w)
        total += len(w)
        for v, s in w:
            assert v not in of or abs(of[v] - s) < 1e-12
    print(hit / total)
    assert hit / total >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.0, 0.0]), (250, None), (300, [float("nan"), 1.0]), (350, [None, 1.0]), (400, [2.0, 0.0]), (401, [0.0, 1.0]), (401, [0.0, 1.0])]
    rows = [(i, e, "x") for i, e in rows]
    got = {}
    for r in op.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(g)] for q, g in got.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 400: [0, 1, 2, 3, 4]}
    few = spark.createDataFrame([(50, [1.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in op.search(few).collect()] == [(50, 1, 1)]
    assert op.search(few.limit(0)).count() == 0


def test_parts_are_parted_again_and_short_parts_widen_the_search(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(0, 1, (12, 8))
    x = (centres[rnd.integers(0, 12, 3000)] + rnd.normal(0, 0.2, (3000, 8))).astype(np.float32)
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    for split in (50_000, 100):
        monkeypatch.setattr(op, "SPLIT", split)
        got = {}
        for r in op.search(vectors).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert all(len(g) == 5 for g in got.values()) and len(got) == 60
        assert np.mean([len(got[q] & {v for v, _ in w}) / 5 for q, w in want.items()]) >= 0.9

    router = op.Router(np.zeros((2, 1)), np.zeros(1), np.zeros((1, 4)), np.array([4.0, 3.0, 2.0, 1.0]), mass=0.1)
    index = op.Index(router, {1: op.Router(np.zeros((2, 1)), np.zeros(1), np.zeros((1, 2)), np.array([0.0, 1.0]), mass=0.1)})
    one = np.ones((1, 2))
    assert index.visits(one, {0: 9, 4096: 9, 4097: 9}, 6) == [[0]]
    assert index.visits(one, {0: 3, 4096: 2, 4097: 2, 8192: 9}, 6) == [[0, 4097, 4096]]
    assert index.visits(one, {0: 1, 12288: 1}, 6) == [[0, 12288]]


def test_vectors_of_other_lengths_are_compared_with_each_other(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 30)] + [(50, [1.0, 0.0, 0.0]), (51, [0.0, 1.0, 0.0]), (52, [1.0, 1.0, 0.0])]
    got = op.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(50, 1, 52), (50, 2, 51)]


def test_vectors_of_doubles_are_searched_as_they_are(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(120, 6))
    x[50] = x[7] + 1e-12  # apart only in double precision
    rows = [(i, e.tolist()) for i, e in enumerate(x)]
    want = brute(rows)
    got = {}
    for r in op.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, w in want.items():
        assert [v for _, v, _ in sorted(got[q])] == [v for v, _ in w]
        assert all(abs(s - t) < 1e-12 for (_, _, s), (_, t) in zip(sorted(got[q]), w))
