import hashlib
import random
import re

from tidewell.llm import op9_secrets as op

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = []
    for order, kind, rx, least, group in [(0, "assign", ASSIGN, 6, 2), (1, "access", re.compile("AKIA[A-Z0-9]+"), 20, 0), (2, "hex", re.compile("[0-9a-f]+"), 24, 0)]:
        out += [(m.start(), order, kind, m.end()) for m in rx.finditer(text) if len(m[group]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans_equal_brute_force_and_random_keys_are_found(spark):
    rnd = random.Random(1)
    bits = ["password: hunter22", "SECRET=token:abcdefgh", "token = 'abc'", "AKIA" + "Q7" * 8, "AKIAAKIA12", "deadbeef" * 4, "é🙂", " word\n", "api_key=\"x.y-z/==\"", "passwd", "= "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 9))) for _ in range(200)]
    texts += ["x ".join(["a1b2c3d4e5f60718293a4b5c"] * 400), None, ""]
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts += [f"é see {key} here", "thonnderwhsthshhaingeresthatation and Internationalizationofeverything"]
    docs = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_hex int").repartition(3)
    got = op.find(docs).collect()
    assert len(got) == len(texts)
    want = sorted((i // 2, ",".join(brute(t or ""))) for i, t in enumerate(texts))
    have = []
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_assign == sum(s.startswith("assign") for s in base) and r.n_hex == sum(s.startswith("hex") for s in base)
        have.append((r.doc_id, ",".join(base)))
    assert sorted(have) == want
    found = [r.spans for r in got if "random" in r.spans]
    assert f"random:6:{6 + len(key)}" in found
    assert len(found) == 1
    assert op.find(docs.limit(0)).count() == 0


def test_battery_rejects_patterns(spark):
    rows = [("a1" * 20,), ("0123456789abcdef" * 3,)]
    got = spark.createDataFrame(rows, "run string").select(op.battery(op.F.col("run")).alias("t")).select(op.passes(op.F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False]


def test_log_tails_are_right_far_out(spark):
    import math

    zs = [-3.0, 0.0, 1.0, 5.0, 10.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(op.log_tail(op.F.col("z"))).collect()]
    for z, x in zip(zs, got):
        want = math.log(math.erfc(z / math.sqrt(2)) / 2)
        assert abs(x - want) < 0.004


def test_recall_and_precision_on_planted_keys(spark):
    """Keys of several encodings among identifiers, sums, dates and patterns that are none."""
    rnd = random.Random(6)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "configuration service internal version release controller handler payment history account report".split()
    rows, keys = [], set()
    for i in range(400):
        kind = i % 4
        if kind == 0:
            run = "".join(rnd.choice(b62) for _ in range(rnd.randrange(36, 60)))
        elif kind == 1:
            run = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(rnd.randrange(40, 60)))
        else:
            run = rnd.choice("_-").join(rnd.choice(words) for _ in range(4)) + str(rnd.randrange(1990, 2030)) if kind == 2 else "".join(rnd.choice(words).title() for _ in range(4)) + "12"
        start = len("see é ")
        if kind < 2:
            keys.add((i, f"random:{start}:{start + len(run)}"))
        rows.append((i, f"see é {run} in the text"))
    got = {(r.doc_id, s) for r in op.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s.startswith("random")}
    mixed = {k for k in keys if k[0] % 4 == 0}
    assert len(got & mixed) >= 0.95 * len(mixed)
    assert len(got & keys) >= 0.8 * len(keys)  # base 32 coincides nearly as often as prose
    assert len(got - keys) <= 0.05 * len(got)


def test_redaction_equals_brute_force_and_keeps_columns(spark):
    rnd = random.Random(9)
    bits = ["password: hunter22", "token=" + "ab12cd34" * 4, "AKIA" + "Q7" * 8, "deadbeef" * 4, "é🙂", " word\n", "secret=AKIA" + "Z9" * 9]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(80)] + [" ".join(["a1b2c3d4e5f60718293a4b5c é"] * 3_000), None, ""]
    rows = [(i, t, "b", [i], "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, tested array<int>, runs string")
    for r in op.redact(docs).collect():
        text = texts[r.doc_id] or ""
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in brute(text))
        out, at, end = [], 0, -1
        for a, b in spans:
            if a > end:
                out += [text[at:a], "[secret]"]
            at = end = max(end, b)
        assert r.text == "".join(out) + text[at:]
        assert (r.base, r.tested, r.runs) == ("b", [r.doc_id], "r")


def test_keys_of_letters_alone_are_found_among_names(spark):
    rnd = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    words = "configuration service internal version release controller handler payment history account report donau dampf schiff".split()
    rows, keys = [], set()
    for i in range(300):
        kind = i % 3
        if kind == 0:
            run = "".join(rnd.choice(letters) for _ in range(48))
            keys.add((i, f"random:4:{4 + len(run)}"))
        else:
            run = "".join(rnd.choice(words).title() if kind == 1 else rnd.choice(words) for _ in range(5))
        rows.append((i, f"see {run} here"))
    rows += [(300, "0123456789" * 4), (301, "Some/Path-With/Signs_But/No-Digits"), (302, "abcdef" * 6)]
    got = {(r.doc_id, s) for r in op.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s.startswith("random")}
    assert len(got & keys) >= 0.95 * len(keys)
    assert len(got - keys) <= 0.05 * len(got)
