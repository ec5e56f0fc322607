import random
import re
import zlib
from collections import Counter

import pytest

from tidewell.llm import op12_spelling as op

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [x for x in words if one_apart(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return rows


def edits(rnd, word):
    i, c = rnd.randrange(len(word)), rnd.choice("abcÿé")
    return rnd.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(4)
    roots = ["".join(rnd.choice("abcdeéÿ") for _ in range(rnd.randrange(5, 14))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "prefixed" * 40]
    texts = []
    for r in roots:
        chain = [r]
        for _ in range(6):
            chain.append(edits(rnd, chain[-1]))
        for k, w in enumerate(chain):
            texts += [w.title() if rnd.random() < 0.2 else w] * rnd.choice([5, 6, 30, 31, 160, 900])
    rnd.shuffle(texts)
    rows = [(i, rnd.choice([" ", "-", "1", "\n"]).join(texts[i * 50 : i * 50 + 50])) for i in range(len(texts) // 50 + 1)]
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (None, None), (999, ""), (1000, "À÷×É ÀÉÈÊËÌ " * 5 + "longest" * 30_000 + " tail")]


def check(got, want):
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [op.TRIE, 40, 1])
def test_groups_equal_brute_force_however_tries_are_parted(spark, docs, monkeypatch, most):
    monkeypatch.setattr(op, "TRIE", most)
    want = brute(counted(docs))
    assert any(v[0] for v in want.values()) and any(v[1] not in (w, v[0]) for w, v in want.items())
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, word string").repartition(4)
    check(op.group(d).collect(), want)


def test_trie_join_equals_comparing_all(rounds=60):
    rnd = random.Random(8)
    for _ in range(rounds):
        texts = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(1, 60))})
        got = sorted(tuple(sorted(p)) for p in op.near_in_trie(texts))
        assert got == sorted((i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if one_apart(texts[i], texts[j]))


def test_many_words_of_one_prefix_and_one_letter_open(spark, monkeypatch):
    """Words that differ in their last letters only stand in tries of one open letter at the end."""
    monkeypatch.setattr(op, "TRIE", 60)
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêë"
    words = {f"begin{a}{b}": 5 + (a + b == "aa") * 100 for a in letters[:12] for b in letters}
    rows = [(w, n) for w, n in words.items()]
    got = {(r.word, r.near) for r in op.near_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_no_documents(spark):
    assert op.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op.group(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0
