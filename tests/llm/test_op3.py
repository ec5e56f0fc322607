import hashlib
import random

from pyspark.sql import functions as F

from tidewell.llm import op3_fingerprints as op


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "DOCS_A_RANGE", 10)
    monkeypatch.setattr(op, "DOCS_A_PART", 40)
    rnd = random.Random(2)
    ids = rnd.sample(range(0, 10**12, 7), 90)
    texts = [" ".join(rnd.choice("a b c dé ee f g Hh i j".split()) for _ in range(rnd.choice([0, 1, 4, 5, 30, 200]))) for _ in ids]
    texts[3] = texts[4]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, range int").repartition(4)
    got = {r.doc_id: r for r in op.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.13
            if len(a | b) <= op.K:
                assert abs(near - true) < 1e-9
        if len(shingles(t)) < op.K:
            assert r.n_shingles == len(shingles(t))
    assert got[rows[3][0]].fingerprint == got[rows[4][0]].fingerprint


def test_sketches_merge_and_edge_cases(spark):
    t = " ".join(f"w{i % 700}" for i in range(1500))
    r = spark.range(1).select(op.distinct_count(op.sketch(F.lit(t))).alias("n"), op.containment(op.sketch(F.lit(t[:900])), op.sketch(F.lit(t))).alias("c")).first()
    assert 560 < r.n < 840 and r.c > 0.8
    docs = spark.createDataFrame([(None, None), (None, "x"), (5, "x y"), (5, "x y")], "doc_id long, text string")
    got = op.fingerprints(docs).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 2
    one = op.fingerprints(docs.limit(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"))).collect()
    assert one[0].near_next == 1.0
    assert op.fingerprints(docs.limit(0)).count() == 0


def test_one_id_or_null_ids_fill_many_ranges_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "DOCS_A_RANGE", 7)
    monkeypatch.setattr(op, "DOCS_A_PART", 30)
    rows = [(5, f"text {i % 4}") for i in range(40)] + [(None, f"none {i % 3}") for i in range(40)] + [(9, "the only nine"), (-1, "long " * 300_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = op.fingerprints(docs).collect()
    assert len(got) == len(rows)
    of = lambda i: [r for r in got if r.doc_id == i]
    long = of(-1)[0]
    assert long.n_chars == 1_500_003
    # nine comes first and goes on with a five, null ids come last and end with nine
    nexts = lambda t: {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for n in {x for _, x in rows}}
    assert of(9)[0].edited_sha256 in nexts("the only nine")
    assert all(any(r.edited_sha256 in nexts(f"none {k}") for k in range(3)) for r in of(None)) and len(of(None)) == 40
    assert sum(r.near_next == 1.0 for r in of(5)) == 36 and sum(r.near_next == 1.0 for r in of(None)) == 37


def test_ranges_are_bounded_in_number(spark, monkeypatch):
    """More rows than ranges may count: ranges grow, and next documents stay the same."""
    monkeypatch.setattr(op, "DOCS_A_RANGE", 2)
    monkeypatch.setattr(op, "DOCS_A_PART", 4)
    docs = spark.range(0, 3000, 1, 5).select((F.col("id") * 37 % 3000).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for most in (250_000, 50):
        monkeypatch.setattr(op, "MOST_RANGES", most)
        heads = op.range_heads(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.lit(0).cast("long").alias("place")).alias("at")))
        n = sum(len(r["heads"]) for r in heads.collect())
        assert 1200 < n < 1800 if most > 50 else 20 < n < 90
        got = {r.doc_id: r.next_text for r in op.with_next(docs).collect()}
        assert got == {i: text[(i - 1) % 3000] for i in text}
