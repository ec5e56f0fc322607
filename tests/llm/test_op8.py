import random
import re

import numpy as np

from tidewell.llm import op8_jaccard_join as op
from tidewell.llm.components import components


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                n[i] += 1
                n[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return n, [top(i) for i in range(len(rows))]


def make_rows():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 9, 30])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(t) + rnd.choice(["", ".", "!"])))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "...")]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)
    rows = make_rows()
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, links long").repartition(4)
    got = {r.doc_id: r for r in op.join(docs).collect()}
    n, root = brute(rows)
    assert len(got) == len(rows)
    assert {i: got[i].links for i, _ in rows} == {i: n[k] for k, (i, _) in enumerate(rows)}
    assert {i: got[i].class_id for i, _ in rows} == {i: rows[root[k]][0] for k, (i, _) in enumerate(rows)}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.links) for r in op.join(docs).collect())
    assert got == [(-1, -1, 0), (-1, 1, 2), (1, 1, 2), (1, 1, 2)]
    assert op.join(docs.limit(0)).count() == 0


def test_pruning_bound_is_the_posterior():
    n, t = 16, op.THRESHOLD
    grid = (np.arange(200_000) + 0.5) / 200_000
    for m in (op.least_matches(n) - 1, op.least_matches(n)):
        like = grid**m * (1 - grid) ** (n - m)
        posterior = like[grid >= t].sum() / like.sum()
        assert (posterior >= op.TOLERANCE) == (m >= op.least_matches(n))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r.v: r.comp for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 102: 100}
