import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from tidewell.llm import op11_filter_audit as op


def fails_of(docs):
    """Sets of failed filters, by the definition."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = set()
        if len(words) < 200:
            own.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            own.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            own.add("C")
        if re.search(r"[#$%&*|]", text):
            own.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs):
            own.add("E")
        out.append(own)
    return out


def brute(docs, labels):
    """Every order, applied to every document."""
    fails = fails_of(docs)
    has = lambda doc_id, k: any(row[0] == doc_id and row[k] == 1 for row in labels if doc_id is not None)
    rows = {}
    for part in {s or "" for _, _, s in docs}:
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                failing = {i for i in own if f in fails[i]}
                gone = failing & left
                redundant = failing - left
                left -= gone
                alone = sum(fails[i] == {f} for i in own)
                lost = [sum(has(docs[i][0], k) for i in gone) for k in (1, 2)]
                rows[part, "".join(order), step] = [len(left), len(gone), len(redundant), alone, *lost]
        for f in "ABCDE":
            total = sum(rows[part, "".join(o), o.index(f) + 1][1] for o in permutations("ABCDE"))
            for o in permutations("ABCDE"):
                rows[part, "".join(o), o.index(f) + 1].append(total)
    return rows


def some_docs():
    rnd = random.Random(5)
    bits = ["Word", "other", "CAPS", "a#b", "x", "é🙂", "tab\tline\n", "wide space", "|"]
    docs = []
    for i in range(60):
        n = rnd.choice([0, 3, 250])
        pool = rnd.sample(bits, rnd.randrange(1, 6)) + [f"w{k}" for k in range(rnd.choice([0, 300]))]
        docs.append((i, " ".join(rnd.choice(pool) for _ in range(n)), rnd.choice(["a", "b", None])))
    docs += [(100 + i, docs[i % 7][1], rnd.choice(["a", "b", ""])) for i in range(40)]  # copies
    docs += [(105, docs[65][1], "a"), (None, docs[3][1], "a"), (None, None, None), (200, None, "c"), (201, "", "c")]  # repeated rows, nulls
    docs.append((300, "long " * 200_000 + "Word", "c"))
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(2, 0, 1), (2, 1, 0), (None, 1, 1), (4, None, None)]
    return docs, [(d, None if q is None else int(q), None if t is None else int(t)) for d, q, t in labels]


def test_audit_equals_brute_force(spark):
    docs, labels = some_docs()
    want = brute(docs, labels)
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, source string, n int, mask string").repartition(5)
    k = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in op.audit(d, k).collect()}
    assert got == want
    assert len(got) == 600 * 4


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    k = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.audit(d, k).count() == 0
    one = op.audit(spark.createDataFrame([(1, "a", "s")], d.schema), k).collect()
    assert len(one) == 600 and {r.kept for r in one if r.step == 5} == {0}


def test_polynomial_integral_is_the_mean_over_orders():
    rnd = random.Random(2)
    counts = {m: rnd.randrange(50) for m in range(32)}
    p = op.Removals(counts)
    for on in range(32):
        assert p.corner(on) == sum(n for m, n in counts.items() if m & on)
    for i in range(5):
        assert p.partial_integral(i) == sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1)
    assert sum(p.over_orders(i) for i in range(5)) == 120 * p.corner(31)


@pytest.mark.parametrize("text,mask", [("", 1), ("A", 5), ("a " * 200, 2), (" ".join(map(str, range(200))), 0), ("x y " * 3, 3), ("$", 9)])
def test_own_mask(spark, text, mask):
    assert spark.createDataFrame([(text,)], "text string").select(op.own_mask(op.F.col("text"))).first()[0] == mask
