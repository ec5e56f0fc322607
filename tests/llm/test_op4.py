import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm import op4_packing as op


def _json():
    with open(public_tokenizers.path(op.TOKENIZER), encoding="utf-8") as f:
        return f.read()


def test_solution_covers_the_counts_with_little_waste():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 5000):
        lengths = np.minimum(rnd.lognormal(5.5, 1, n).astype(int) + 1, 2047)
        counts = np.bincount(lengths, minlength=2049).astype(np.int64) if n else np.zeros(2049, np.int64)
        used = np.zeros(2049, np.int64)
        sequences = 0
        for pattern, uses in op.solve(counts, 2048):
            assert sum(pattern) <= 2048 and uses > 0
            sequences += uses
            for s in pattern:
                used[s] += uses
        assert (used == counts).all()
        assert sequences <= -(-lengths.sum() // 2048) * 1.03 + 2


def test_knapsack_equals_exhaustive_search():
    prices = np.array([0.1, 0.0, 0.35, 0.5, 0.0])
    worth, pattern = op.best_pattern(prices, 10)
    best = max(0.1 * a + 0.35 * c + 0.5 * d for a in range(11) for c in range(4) for d in range(3) if a + 3 * c + 4 * d <= 10)
    assert abs(worth - best) < 1e-9 and abs(sum(prices[s - 1] for s in pattern) - best) < 1e-9


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "réeux", "x1", "\n", "<|endoftext|>"]) for _ in range(rnd.choice([0, 3, 300, 3000]))) for _ in range(60)]
    rows = [(i // 2, t, 1) for i, t in enumerate(texts)] + [(None, None, 0), (99, None, 0)] + [(100, "same text", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(5)
    got = op.pack(op.pieces(docs, _json())).collect()
    tok = Tokenizer.from_str(_json())
    tok.encode_special_tokens = True
    want = []
    for doc_id, text, _ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            p = ids[a : a + 2048]
            want.append((doc_id, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert op.pack(op.pieces(docs.limit(0), _json())).count() == 0


def test_program_reaches_its_bound_where_best_fit_does_not():
    """Two thirds and a third: best fit, longest first, joins what should not be joined."""
    counts = np.zeros(101, np.int64)
    counts[[44, 30, 26, 24]] = 300  # 44 + 30 + 26 fills a sequence; 24 goes four times
    patterns, over = op.plan(counts, 100)
    assert over <= max(op.GAP, 1 / 375)
    used = np.zeros(101, np.int64)
    for pattern, uses in patterns:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += uses
    assert (used == counts).all()
    assert sum(u for _, u in patterns) <= 375 + 4


def test_real_lengths_leave_little_padding():
    rnd = np.random.default_rng(1)
    lengths = rnd.lognormal(6.3, 1.3, 40_000).astype(int) % 2047 + 1
    counts = np.bincount(lengths, minlength=2049).astype(np.int64)
    assert sum(u for _, u in op.solve(counts, 2048)) <= lengths.sum() / 2048 * 1.002 + 2


def test_long_texts_and_pieces_encode_as_the_library_does(spark):
    rnd = random.Random(2)
    texts = ["x" * 300_000, "".join(rnd.choice("abcdé \x00\x01ÿ\n0") for _ in range(200_000)), " " * 70_000 + "　y" * 9_000, "a\x00b\x00", "ÿÿ þ", "\x00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_str(_json())
    for r in op.pieces(docs, _json()).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_added_tokens_are_those_of_the_plain_call(spark):
    rnd = random.Random(8)
    mark = "<|endoftext|>"
    bits = [mark, mark[:-1], "|>", " ", "\n", "réeux", "x1", "<|", mark * 2]
    texts = [mark, mark * 3, f"a {mark} b", f" {mark}\n", "", None] + ["".join(rnd.choice(bits) for _ in range(rnd.choice([2, 9, 4000]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tok = Tokenizer.from_str(_json())
    assert tok.encode(f"a {mark} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = op.pieces(docs, _json(), added=True).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    for r in got:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_what_a_worker_keeps_is_bounded():
    rnd = random.Random(4)
    cache = op.PieceCache(_json())
    tracemalloc.start()
    try:
        for _ in range(26):
            for _ in op.encoded_texts([" ".join("".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(300)) for _ in range(100)], cache):
                pass
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 85e6, held
